"""Every query of the reference's inventory by name, over the bridged tables, with DuckDB SQL that gives the same rows.

Floats are rounded on both sides: sums may differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exprs as x
from ..operators import chartdata as ch, monitoring as mo, replay as rp, traffic as t
from . import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FLOWS = "flows as (select flow_id, min_by(struct_pack(method, batch_size, duration_ms, ts_start, http_status, flow_req_bytes, flow_resp_bytes), position) as f from calls group by flow_id), fl as (select flow_id, unnest(f) from flows)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def add(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    """A query over calls; sql may use `calls` and `fl`, one row a flow."""
    QUERIES[name] = lambda spark, d: _rounded(make(bridge.calls(spark, d)), digits)
    if sql:
        SQL[name] = f"with {bridge.CALLS_SQL}, {FLOWS} {sql if sql.lstrip().startswith(',') else 'select * from (' + sql + ')'}"


def add_pair(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: _rounded(make(*bridge.before_after(spark, d)))
    if sql:
        SQL[name] = f"with {bridge.CALLS_SQL}, {FLOWS}, sided as (select *, case when ts_start < {bridge.HALF} then 'a' else 'b' end as side from calls), sfl as (select *, case when ts_start < {bridge.HALF} then 'a' else 'b' end as side from fl) {sql}"


def add_points(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: _rounded(make(bridge.points(spark, d)))
    if sql:
        SQL[name] = f"with {bridge.POINTS_SQL}, s as (select window_name as \"window\", metric, t, max_by(v, ordinal) as v from points where metric <> 'cpu' group by all) {sql}"


def lin(v: str, q: float) -> str:
    return f"round(quantile_cont({v}, {q}), 6)"


def idx(v: str, rule: str, q: float) -> str:
    at = {"nearest": f"round((count({v}) - 1) * {q})", "lower": f"floor((count({v}) - 1) * {q})", "half_even": f"round_even((count({v}) - 1) * {q}, 0)", "floor_np": f"least(count({v}) - 1, floor(count({v}) * {q}))"}[rule]
    return f"round((list_sort(list({v}) filter ({v} is not null)))[{at}::int + 1], 6)"


def qs(v: str, rule: str = "linear", names: str = "p50 p95 p99") -> str:
    share = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return ", ".join(f"{lin(v, share[n]) if rule == 'linear' else idx(v, rule, share[n])} as {n}" for n in names.split())


def _ms(v: str) -> str:
    return f"case when {v} < 10 then printf('%.1f ms', {v}) else printf('%.0f ms', {v}) end"


def _human(v: str, short: bool) -> str:
    def one(size: str, name: str) -> str:
        return f"case when {v} / {size} < 100 then printf('%.1f{name}', {v} / {size}) else printf('%.0f{name}', {v} / {size}) end" if short else f"printf('%.1f{name}', {v} / {size})"

    return f"case when abs({v}) >= 1e6 then {one('1e6', 'M')} when abs({v}) >= 1e3 then {one('1e3', 'k')} else printf('%.0f', {v}::double) end"


def case(value: str, steps) -> str:
    return "case " + " ".join(f"when {value} <= {top} then '{name}'" for name, top in steps if top) + f" else '{steps[-1][0]}' end"


BUCKET, SIZES, REPLAY = case("batch_size", x.BUCKETS), case("batch_size", (("1", 1), *x.BUCKETS)), case("batch_size", x.REPLAY_BUCKETS)
SPACE = "case " + " ".join(f"when starts_with(method, '{p}') then '{n}'" for n, p in x.NAMESPACES) + " else 'other' end"
BFLOWS = f"select *, duration_ms / batch_size as per_call_ms, {BUCKET} as bucket from fl where batch_size > 1"

# ---- latency
add("a1_singleton_per_method", t.singleton_per_method, f"select method, count(*) as n, round(avg(duration_ms), 6) as mean, round(max(duration_ms), 6) as max, {qs('duration_ms')} from calls where batch_size = 1 group by method")
add("a2_singleton_overall", t.singleton_overall, f"select count(*) as n, round(avg(duration_ms), 6) as mean, {qs('duration_ms', names='p50 p95')} from calls where batch_size = 1 and duration_ms is not null")
add("a3_top_singleton_methods", t.top_singleton_methods, "select method, count(*) as n from calls where batch_size = 1 group by method order by n desc, method limit 10")
add("a4_batch_flows", t.batch_flows, f"select flow_id, batch_size, round(duration_ms, 6) as duration_ms, round(per_call_ms, 6) as per_call_ms, bucket from ({BFLOWS})")
for _v in ("duration_ms", "per_call_ms"):
    add(f"a5_buckets_{_v}", lambda c, v=_v: t.summarise_buckets(t.batch_flows(c), v), f"select bucket, count(*) as flows, round(avg({_v}), 6) as mean, {qs(_v)} from ({BFLOWS}) group by bucket")
VIEWS = "select 'per-flow' as view, duration_ms as v from fl where duration_ms is not null union all select 'per-call', duration_ms / batch_size from calls where duration_ms is not null"
add("a6_overall_latency", t.overall_latency, f"select view, round(avg(v), 6) as avg, {qs('v')} from ({VIEWS}) group by view")
XOUT = ["eth_Brand#11", "eth_call"]
XSQL = "method not in ('eth_Brand#11', 'eth_call')"
add("a7_per_flow_frame", lambda c: t.per_flow_frame(c, XOUT), f"select flow_id, min_by(method, position) as method, round(min_by(duration_ms, position), 6) as v from calls where duration_ms is not null and {XSQL} group by flow_id")
add("a8_per_call_frame", lambda c: t.per_call_frame(c, XOUT).groupBy("method").agg(F.count("*").alias("n"), F.sum("v").alias("v")), f"select method, count(*) as n, round(sum(duration_ms / batch_size), 2) as v from calls where duration_ms is not null and {XSQL} group by method", 2)
PC = "select side, method, duration_ms / batch_size as v from sided where duration_ms is not null"
PF = "select side, flow_id, min_by(method, position) as method, min_by(duration_ms, position) as v from sided where duration_ms is not null group by side, flow_id"
add_pair("a9_ref_shares", lambda a, b: t.ref_shares(t.per_call_frame(a), t.per_call_frame(b)), ", p as (" + PC + ") select method, round(count(*) / (select count(*) from p), 6) as share from p group by method")
_RW = """, p as ({frames}), ref as (select view, method, count(*) as c, sum(count(*)) over (partition by view) as n from p group by view, method),
 own as (select view, side, method, count(*) as c, sum(count(*)) over (partition by view, side) as n from p group by view, side, method),
 w as (select own.view, own.side, own.method, (ref.c / ref.n) / (own.c / own.n) as w from own join ref on own.view = ref.view and own.method = ref.method),
 a as (select view, side, v, sum(w) as w from p join w using (view, side, method) group by view, side, v),
 k as (select *, sum(w) over (partition by view, side order by v) as cum, sum(w) over (partition by view, side) as total from a)
 select view, case side when 'a' then 'before' else 'after' end as side, round(sum(w * v) / max(total), 6) as mean, """ + ", ".join(f"round(min(v) filter (cum >= {q} * total * (1 - 1e-12)), 6) as {n}" for n, q in t.Q3.items()) + " from k group by view, side"
add_pair("a10_reweighted", t.compare_reweighted, _RW.format(frames=f"select 'flow' as view, side, method, v from ({PF}) union all select 'call', side, method, v from ({PC})"))
# ---- coverage
add("a11_headline", t.headline, "select round(min(ts_start), 6) as first, round(max(ts_start), 6) as last, round(max(ts_start) - min(ts_start), 6) as span_seconds, count(distinct flow_id) as flows, count(*) as calls, round(count(distinct flow_id) / (max(ts_start) - min(ts_start)), 6) as req_per_s, round(count(*) / (max(ts_start) - min(ts_start)), 6) as calls_per_s from calls")
DIST = f"select {SIZES} as bucket, count(*) as flows, sum(batch_size)::bigint as calls from fl group by 1"
add("a12_batch_distribution", t.batch_distribution, DIST)
add("a13_top_methods", t.top_methods, "select method, count(*) as calls, count(distinct flow_id) as flows from calls group by method order by calls desc, method limit 15")
add("a14_error_codes", t.error_codes, "select error_code, count(*) as calls from calls where error_code is not null group by error_code order by calls desc, error_code limit 10")
COVER = f"select {SPACE} as namespace, count(distinct method) as methods, count(*) as calls from calls group by 1"
add("a15_namespace_coverage", t.namespace_coverage, COVER)
add("a16_namespace_bytes", t.namespace_bytes, f"select {SPACE} as namespace, sum(flow_resp_bytes)::bigint as bytes from fl group by 1")
add("a17_distinct_methods", t.distinct_methods, "select count(distinct method) as methods from calls")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = n.selectExpr("cast(n_nationkey as long) flow_id", "0 position", "'web3_clientVersion' method", "concat('\"', lower(n_name), '/', n_nationkey, '.1.0+git.abcdef0', n_nationkey, '+x\"') result_json", "cast(n_nationkey * 100 as double) ts_start")
    return t.node_identity(rows, lotus_version=None)


QUERIES["a18_node_identity"] = _nodes
SQL["a18_node_identity"] = "with l as (select * from nation order by n_nationkey desc limit 1) select upper(left(n_name, 1)) || lower(substr(n_name, 2)) as agent, 'v' || n_nationkey || '.1.0' as version, 'abcdef0' || n_nationkey as \"commit\", '1970-01-01' as capture_date, upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ': v' || n_nationkey || '.1.0' as label from l"
# ---- summary
_TS = "strftime(make_timestamp(({c} * 1000000)::bigint), '%Y-%m-%d %H:%M:%S')"
add("a19_capture_window", t.capture_window, f", w as (select min(ts_start) as a, max(ts_start) as b, floor(max(ts_start) - min(ts_start))::bigint as s from calls) select {_TS.format(c='a')} as first_utc, {_TS.format(c='b')} as last_utc, (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' as span from w")
add("a20_a21_summary_counts", t.summary_counts, 'select count(*) as "rows", count(distinct flow_id) as flows, count(distinct flow_id) filter (http_status is null) as no_response, count(result_json) as success, count(error_code) as errors, count(distinct flow_id) - count(distinct flow_id) filter (http_status is null) as replied, count(*) - count(result_json) - count(error_code) as no_answer from calls')
_ORDER = "(values (0, '1'), (1, '2-10'), (2, '11-50'), (3, '51-99'), (4, '100+')) as o(bucket_ord, bucket)"
add("a22_bucket_table", t.bucket_table, f"select bucket_ord, o.bucket, coalesce(flows, 0) as flows, coalesce(calls, 0) as calls from {_ORDER} left join ({DIST}) d on o.bucket = d.bucket")
add("a23_flow_latency", t.flow_latency, f"select round(avg(duration_ms), 6) as avg, round(max(duration_ms), 6) as max, {qs('duration_ms', 'nearest')} from fl")
add("a24_call_latency", t.call_latency, f"select round(avg(v), 6) as avg, round(max(v), 6) as max, {qs('v', 'nearest')} from (select duration_ms / batch_size as v from calls)")
add("a25_body_sizes", t.body_sizes, f"select side, max(v) as max, {qs('v', 'nearest', 'p50 p95')} from (select 'request' as side, flow_req_bytes as v from fl union all select 'response', flow_resp_bytes from fl) group by side")
SQL["a25_body_sizes"] = SQL["a25_body_sizes"].replace("flow_req_bytes as v from fl", "flow_req_bytes::double as v from fl").replace("max(v) as max", "max(v)::bigint as max")
add("a26_status_distribution", t.status_distribution, "select http_status, count(*) as flows from fl group by http_status")
# ---- task tables
add("a27_latency_by_method", t.latency_by_method, f"select method, count(*) as n, round(avg(duration_ms), 6) as avg, round(max(duration_ms), 6) as max, {qs('duration_ms', 'nearest')} from calls where batch_size = 1 group by method order by n desc, method limit 30")
add("a28_batch_latency_by_bucket", t.batch_latency_by_bucket, f"select bucket, count(*) as flows, round(avg(duration_ms), 6) as mean, round(max(duration_ms), 6) as max, {qs('duration_ms', 'nearest')} from ({BFLOWS}) group by bucket")
add("a29_batch_latency_by_method", t.batch_latency_by_method, f"select method, count(*) as flows, median(batch_size)::double as median_batch, round(avg(duration_ms), 6) as avg, {qs('duration_ms', 'nearest')} from (select distinct flow_id, method, batch_size, duration_ms from calls where batch_size > 1) group by method order by flows desc, method limit 30")
add("a30_errors_by_method", t.errors_by_method, "select method, count(*) as calls, count(error_code) as errors, round(count(error_code) / count(*) * 100, 2) as err_pct from calls group by method order by calls desc, method limit 30")
_PCT = "round(({m}_b - {m}_a) / nullif({m}_a, 0) * 100, 6)"


def _side_sql(key: str, base: str, v: str, rule: str, extra: str) -> str:
    names = ["mean", "p50", "p95", "p99"]
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    cols = ", ".join([f"avg({v}) as mean", *(f"{('quantile_cont(' + v + ', ' + str(s) + ')') if rule == 'linear' else idx(v, rule, s)[6:-4]} as {n}" for n, s in q.items())])
    one = f"(select {key}, {extra}, {cols} from ({base}) where side = '{{s}}' group by {key})"
    return f"select coalesce(x.{key}, y.{key}) as {key}, x.n as n_a, y.n as n_b, " + ", ".join(f"x.{n} as {n}_a, y.{n} as {n}_b" for n in names) + f" from {one.format(s='a')} x full join {one.format(s='b')} y on x.{key} = y.{key}"


_METRICS = ("mean", "p50", "p95", "p99")
for _sort in ("n", "p95", "p50", "p99", "mean"):
    _key = "greatest(n_a, n_b)" if _sort == "n" else f"abs({_sort}_b - {_sort}_a)"
    add_pair(
        f"a31_compare_methods_by_{_sort}",
        lambda a, b, s=_sort: t.compare_methods(a, b, sort=s, exclude=XOUT).drop("rank_key"),
        f", j as ({_side_sql('method', 'select * from sided where batch_size = 1 and ' + XSQL, 'duration_ms', 'nearest', 'count(*) as n')}) select method, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b, "
        + ", ".join(f"round({m}_a, 6) as {m}_a, round({m}_b, 6) as {m}_b, round({m}_b - {m}_a, 6) as d_{m}, {_PCT.format(m=m)} as d_{m}_pct" for m in _METRICS)
        + f" from j order by {_key} desc nulls last, method limit 30",
    )
_OV = "select side, 'flow' as view, duration_ms as v from sfl where duration_ms is not null union all select side, 'call', duration_ms / batch_size from sided where duration_ms is not null"
add_pair(
    "a32_compare_overall",
    t.compare_overall,
    f", j as ({_side_sql('view', _OV, 'v', 'lower', 'count(*) as n')}), m as (" + " union all ".join(f"select view, '{'avg' if m == 'mean' else m}' as metric, {m}_a as before, {m}_b as after from j" for m in _METRICS) + ") select view, metric, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta, round(case when before = 0 then 0 else (after - before) / before * 100 end, 6) as delta_pct from m",
)
add_pair("a33_compare_reweighted_without", lambda a, b: t.compare_reweighted(a, b, XOUT), _RW.format(frames=f"select 'flow' as view, side, method, v from ({PF.replace('where ', 'where ' + XSQL + ' and ')}) union all select 'call', side, method, v from ({PC.replace('where ', 'where ' + XSQL + ' and ')})"))
_BS = f"select side, {BUCKET} as bucket, duration_ms, duration_ms / batch_size as per_call_ms from sfl where batch_size > 1"
_ORD = "list_position(['1', '2-10', '11-50', '51-99', '100+'], bucket)::int"
_CB = " union all ".join(
    f"select '{v}' as view, bucket, {_ORD} as bucket_ord, coalesce(n_a, 0) as flows_a, coalesce(n_b, 0) as flows_b, " + ", ".join(f"round({m}_a, 6) as {m}_a, round({m}_b, 6) as {m}_b" for m in _METRICS) + ", " + ", ".join(f"{_PCT.format(m=m)} as d_{m}_pct" for m in ("mean", "p50", "p95")) + f" from ({_side_sql('bucket', _BS, v, 'nearest', 'count(*) as n')})"
    for v in ("duration_ms", "per_call_ms")
)
add_pair("a34_compare_batches", t.compare_batches, f", u as ({_CB}) select * from u")
add("a35_popular_params", t.popular_params, """, p as (select method, params_json, count(*) as c from calls group by all), k as (select method, sum(c)::bigint as total, count(*) as d from p group by method order by total desc, method limit 15),
 z as (select p.method, total, d, c, params_json, row_number() over (partition by p.method order by c desc, params_json nulls first) as k from p join k on p.method = k.method) select method, total, d as distinct_params, k::int as rank, c as count, coalesce(params_json, '<no params>') as params from z where k <= 5""")
add("t3_slow_flows", t.slow_flows, ", z as (select *, row_number() over (partition by flow_id order by duration_ms desc nulls last, position) as k from calls) select flow_id, round(duration_ms, 6) as duration_ms, batch_size, method, error_code, left(error_message, 80) as error_message, left(params_json, 200) as params_json from z where k = 1 order by duration_ms desc nulls last, flow_id limit 15")
_SLOW = "row_number() over (partition by flow_id order by duration_ms desc nulls last, position) as k from calls"
add("t3_slow_flows_of_method", lambda c: t.slow_flows(c, "eth_call", 20, 0, 0), f", z as (select *, {_SLOW} where method = 'eth_call') select flow_id, round(duration_ms, 6) as duration_ms, batch_size, method, error_code, error_message, params_json from z where k = 1 order by duration_ms desc nulls last, flow_id limit 20")
add("a35_popular_params_of_method", lambda c: t.popular_params(c, "eth_call", params=20), """, p as (select params_json, count(*) as c from calls where method = 'eth_call' group by all), z as (select *, row_number() over (order by c desc, params_json nulls first)::int as rank, sum(c) over ()::bigint as total, count(*) over () as d from p)
 select 'eth_call' as method, total, d as distinct_params, rank, c as count, coalesce(params_json, '<no params>') as params from z where rank <= 20""")
_PEEK = ["flow_id", "position", "batch_size", "ts_start", "duration_ms", "http_status", "method", "params_json", "result_json", "error_code", "error_message", "flow_req_bytes", "flow_resp_bytes"]
add("p20_peek", t.peek, f"select {', '.join('round(' + c + ', 6) as ' + c if c in ('ts_start', 'duration_ms') else c for c in _PEEK)} from calls order by flow_id, position limit 5")
_KIND = "case typeof({c}) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' else 'string' end"
add("p20_schema", t.schema_of, ", one as (select * from calls limit 1) " + " union all ".join(f"select {i} as ordinal, '{c}' as \"column\", {_KIND.format(c=c)} as type from one" for i, c in enumerate(_PEEK)))
# ---- replay
add("a43_replay_counters", rp.counters, "select count(*) as calls, count(error_code) as rpc_errors, count(distinct method) as methods, (select count(*) from fl) as flows, (select count(*) from fl where http_status >= 400) as http_errors from calls")
add("a43_replay_batch_sizes", rp.batch_sizes, "select batch_size, count(*) as flows from fl group by batch_size")
add("a43_replay_method_counts", rp.method_counts, "select method, count(*) as calls from calls group by method order by calls desc, method limit 20")
add("a44_replay_latency", rp.latency_by_bucket, f"select {REPLAY} as bucket, count(*) as flows, round(max(duration_ms), 6) as max, {qs('duration_ms', 'floor_np')} from fl where duration_ms is not null group by 1")
add("a44_replay_latency_overall", rp.latency_overall, f"select 'overall' as bucket, count(*) as flows, round(max(duration_ms), 6) as max, {qs('duration_ms', 'floor_np')} from fl where duration_ms is not null having count(*) > 0")
add("a44_replay_body_sizes", rp.body_sizes, f", b as (select 'request' as body, flow_req_bytes::double as bytes from fl union all select 'response', flow_resp_bytes::double from fl) select body, count(*) as flows, max(bytes) as max, sum(bytes) as total, {qs('bytes', 'floor_np', 'p50 p95')} from b where bytes is not null group by body")
add("a43_replay_methods", rp.methods, f", top as (select method, count(*) as calls, count(*) filter (batch_size = 1) as singles from calls group by method order by calls desc, method limit 30), l as (select method, {qs('duration_ms', 'floor_np')} from calls where batch_size = 1 and duration_ms is not null group by method) select top.*, p50, p95, p99 from top left join l on top.method = l.method")
add("a43_replay_error_codes", rp.error_codes, "select error_code, count(*) as calls from calls where error_code is not null group by error_code")
add("a43_replay_status_errors", rp.status_errors, "select http_status, count(*) as flows from fl where http_status >= 400 group by http_status")
add("z2_replay_slowest_flows", rp.slowest_flows, "select flow_id, method, round(duration_ms, 6) as duration_ms, batch_size, flow_req_bytes, flow_resp_bytes from fl where duration_ms is not null order by fl.duration_ms desc, flow_id limit 20")
add("a45_replay_slowest_methods", rp.slowest_methods, f"select method, count(*) as n, {qs('duration_ms', 'floor_np')} from calls where batch_size = 1 and duration_ms is not null group by method having count(*) >= 10 order by p95 desc, method limit 15")
add("a46_replay_errors", rp.errors_by_method, ", c as (select method, error_code, count(*) as c from calls group by all) select method, sum(c)::bigint as calls, coalesce(sum(c) filter (error_code is not null), 0)::bigint as errors, string_agg(error_code || ':' || c, ',' order by c desc, error_code) filter (error_code is not null) as codes, round(sum(c) filter (error_code is not null) / sum(c) * 100, 6) as err_pct from c group by method having errors > 0 order by errors desc, method limit 20")
add("a47_replay_error_samples", rp.error_samples, ", p as (select method, error_code, count(*) as c from calls where error_code is not null group by all order by c desc, method, error_code limit 8), z as (select q.method, q.error_code, c, row_number() over (partition by q.method, q.error_code order by flow_id, position) as k, flow_id, position, error_message, params_json from calls q join p on q.method = p.method and q.error_code = p.error_code) select method, error_code, c as count, k::int as k, flow_id, position, error_message, params_json from z where k <= 3")
add("p22_flows_with_method", lambda c: rp.flows_with_method(c, "eth_Brand#11"), "select flow_id, round(max(duration_ms), 6) as duration_ms, max(batch_size) as batch_size, count(*) as calls from calls group by flow_id having bool_or(method = 'eth_Brand#11') and max(duration_ms) is not null order by max(duration_ms) desc, flow_id limit 20")
# ---- charts
add("a48_reliability", ch.reliability, f"select calls, na as no_answer, calls - na as answered, round((calls - na) / calls * 100, 6) as answered_pct, bytes, round(calls / span, 6) as calls_per_s, p50, p95, methods from (select count(*) as calls, count(*) filter (result_json is null and error_code is null) as na, count(distinct method) as methods, max(ts_start) - min(ts_start) as span from calls), (select sum(flow_resp_bytes)::bigint as bytes, {qs('duration_ms', names='p50 p95')} from fl)")
add("a49_batching", ch.batching, f", d as (select bucket_ord, o.bucket, coalesce(flows, 0) as flows, coalesce(calls, 0) as calls from {_ORDER} left join ({DIST}) d on o.bucket = d.bucket), c as (select bucket, avg(per_call_ms) as cost from ({BFLOWS}) group by bucket), e as (select avg(duration_ms) as alone from calls where batch_size = 1 and method = 'eth_call') select bucket_ord, d.bucket, flows, calls, round(calls / (select sum(calls) from d) * 100, 6) as share_pct, round(case when d.bucket = '1' then alone else cost end, 6) as cost, round(alone / case when d.bucket = '1' then alone else cost end, 6) as times_cheaper from d left join c on d.bucket = c.bucket, e")
add("a50_mix", ch.mix, f"select *, round(calls / sum(calls) over () * 100, 6) as share_pct from ({COVER}) where namespace <> 'other'")
_LIN = _side_sql("method", "select * from sided where batch_size = 1", "duration_ms", "linear", "count(*) as n, max(duration_ms) as mx").replace("x.n as n_a, y.n as n_b,", "x.n as n_a, y.n as n_b, x.mx as max_a, y.mx as max_b,")
add_pair("a51_method_pairs", lambda a, b: ch.method_pairs(a, b).drop("most"), f", j as ({_LIN}) select method, n_a, n_b, round(max_a, 6) as max_a, round(max_b, 6) as max_b, " + ", ".join(f"round({m}_a, 6) as {m}_a, round({m}_b, 6) as {m}_b" for m in _METRICS) + " from j where mean_a is not null and mean_b is not null order by greatest(n_a, n_b) desc, method limit 30")
_GAP = "case when abs(after - before) >= 1000 then printf('%.2f s', abs(after - before) / 1000) else printf('%.2f ms', abs(after - before)) end"
_VERDICT = "case when abs(c) < 3 then 'same' when c < 0 then 'better' else 'worse' end"
add_pair("a52_batch_dumbbells", ch.batch_dumbbells, f", j as ({_side_sql('bucket', _BS, 'duration_ms', 'linear', 'count(*) as n')}), m as (" + " union all ".join(f"select bucket, n_a, n_b, '{'avg' if m == 'mean' else m}' as metric, {m}_a as before, {m}_b as after from j" for m in _METRICS[:3]) + f"), z as (select *, case when before = 0 then 0 else (after - before) / before * 100 end as c from m) select bucket, n_a as flows_a, n_b as flows_b, metric, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta, round(sqrt(before * after), 6) as label_x, {_VERDICT} as verdict, case when abs(c) < 3 then '≈ equivalent (' || {_GAP} || ')' else {_GAP} || case when after < before then ' faster' else ' slower' end end as label, '(' || {_human('n_a', False)} || '→' || {_human('n_b', False)} || ' flows)  ' || bucket as bucket_label, round(median(after - before) over (), 6) as median_delta, case when median(after - before) over () < 0 then 'better' when median(after - before) over () > 0 then 'worse' else 'same' end as overall from z where before is not null and after is not null and n_a is not null and n_b is not null")
_OVL = "select side, 'per-flow' as view, duration_ms as v from sfl where duration_ms is not null union all select side, 'per-call', duration_ms / batch_size from sided where duration_ms is not null"
add_pair("a53_overall_pairs", ch.overall_pairs, f", j as ({_side_sql('view', _OVL, 'v', 'linear', 'count(*) as n')}), m as (" + " union all ".join(f"select view, '{'avg' if m == 'mean' else m}' as metric, {m}_a as before, {m}_b as after from j" for m in _METRICS) + "), z as (select *, case when before = 0 then 0 else (after - before) / before * 100 end as c, median(case when before = 0 then 0 else (after - before) / before * 100 end) over (partition by view) as md from m) select view, metric, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta, round(c, 6) as delta_pct, round(md, 6) as median_pct, case when md < 0 then 'better' when md > 0 then 'worse' else 'same' end as verdict from z")
_CURVE = "select side, unnest({p})::double as q, unnest(quantile_cont(duration_ms, {p})) as d from sfl where duration_ms is not null group by side"
_PHASE = "case side when 'a' then 'before' else 'after' end as phase"
add_pair("a54_cdf", ch.cdf, f", v as ({_CURVE.format(p=ch.CDF_POINTS)}) select {_PHASE}, round(q, 6) as q, round(d, 6) as duration_ms from v")
_MARKS = list(ch.CDF_MARKS.values())
add_pair("a54_cdf_marks", ch.cdf_marks, f", v as ({_CURVE.format(p=_MARKS)}) select {_PHASE}, q, round(d, 6) as duration_ms, case q when 0.5 then 'median ' else 'p95 ' end || {_ms('d')} as label from v")
_S = "select method, count(*) as n, avg(duration_ms) as mean, quantile_cont(duration_ms, 0.95) as p95 from sided where batch_size = 1 and side = '{s}' group by method"
add_pair(
    "a55_scorecard",
    ch.scorecard,
    f", b as ({_S.format(s='b')} order by n desc, method limit 10), a as ({_S.format(s='a')}), z as (select b.method, b.n as n_b, b.mean as mean_b, b.p95 as p95_b, a.n as n_a, a.mean as mean_a, a.p95 as p95_a, a.n < 100 as low from b left join a on a.method = b.method where a.mean is not null) select method, n_a, n_b, "
    + ", ".join(f"round({m}_a, 6) as {m}_a, round({m}_b, 6) as {m}_b, round(case when low then 0 else greatest(-50, least(50, case when {m}_a = 0 then 0 else ({m}_b - {m}_a) / {m}_a * 100 end)) end, 6) as {m}_chg, not low and abs(case when {m}_a = 0 then 0 else ({m}_b - {m}_a) / {m}_a * 100 end) < 3 as {m}_same" for m in ("mean", "p95"))
    + ", low from z",
)
add("a56_bandwidth", ch.bandwidth, "select method, sum(flow_resp_bytes)::bigint as bytes, (select sum(flow_resp_bytes)::bigint from fl) as total_bytes, case when sum(flow_resp_bytes) >= 1e9 then printf('%.2f', sum(flow_resp_bytes)::double / 1e9) || ' GB' else printf('%.0f', sum(flow_resp_bytes)::double / 1e6) || ' MB' end as label from calls where batch_size = 1 group by method order by bytes desc, method limit 8")
add("a57_load_latency", lambda c: ch.load_latency(c, 86400 * 30), ", z as (select *, min(ts_start) over () as t0 from fl where duration_ms is not null), b as (select floor((ts_start - t0) / 2592000)::bigint as bin, sum(batch_size) / 2592000 as calls_s, quantile_cont(duration_ms, 0.95) as p95 from z group by 1) select bin, round(calls_s, 6) as calls_s, round(p95, 6) as p95, round((select regr_slope(p95, calls_s) from b), 1) as slope, round((select regr_intercept(p95, calls_s) from b), 1) as intercept from b", 6)
_load = QUERIES["a57_load_latency"]
QUERIES["a57_load_latency"] = lambda spark, d: _load(spark, d).withColumns({c: F.round(c, 1) for c in ("slope", "intercept")})
add("a58_error_kinds", ch.error_kinds, f", o as (select count(*) as n, count(result_json) as s, count(error_code) as e, count(*) filter (error_code is not null and (method in ('eth_call', 'eth_estimateGas', 'eth_createAccessList') or coalesce(regexp_matches(error_message, '{x.REVERT_TEXT}'), false))) as r from calls), k as (select 'result' as kind, s as calls, n from o union all select 'revert', r, n from o union all select 'error', e - r, n from o union all select 'no answer', greatest(0, n - s - e), n from o) select kind, calls, round(calls / n * 100, 6) as pct from k where calls > 0")
add("a61_per_flow", ch.per_flow, "select flow_id, round(duration_ms, 6) as duration_ms, round(ts_start, 6) as ts_start, batch_size from fl where duration_ms is not null")
add("a62_date_label", ch.date_label, ", w as (select min(ts_start) as a, max(ts_start) as b from calls) select strftime(make_timestamp((a * 1000000)::bigint), '%b %-d, %Y') as first_day, strftime(make_timestamp((b * 1000000)::bigint), '%b %-d, %Y') as last_day, round(a, 6) as t0, round((b - a) / 3600, 6) as hours from w")
# ---- monitoring
_MEM = "select a.\"window\", a.t, (a.v - b.v) / 1073741824.0 as gib from s a join s b on a.\"window\" = b.\"window\" and a.t = b.t where a.metric = '{a}' and b.metric = '{b}'"
MEMORY, DISK = _MEM.format(a="memory_total", b="memory_available"), _MEM.format(a="filesystem_size", b="filesystem_free")
CPU = """, c as (select window_name as "window", t, mode, max_by(v, ordinal) as v from points where metric = 'cpu' group by all), nm as (select "window", count(distinct mode) as n from c group by 1),
 fu as (select c."window", t from c join nm on c."window" = nm."window" group by c."window", t, n having count(*) = n),
 st as (select c."window", mode, lag(c.t) over w as a, c.t as b, v - lag(v) over w as d from c join fu on c."window" = fu."window" and c.t = fu.t window w as (partition by c."window", mode order by c.t)),
 ea as (select "window", a, b, sum(d) as total, min(d) as least_d, coalesce(sum(d) filter (mode = 'idle'), 0) as idle from st where a is not null group by all),
 cs as (select "window", (a + b) // 2 as t, 100 * (1 - idle / total) as util, total / (b - a) as cores from ea where total > 0 and b > a and least_d >= 0) """
_P95 = lambda v, n: f"{idx(v, 'half_even', 0.95)} as {n}"
MST = f"""select u."window", used_p95, used_min, used_mean, used_max, n, round(total, 6) as total, round(100 * m / total, 6) as pct_mean, round(100 * used_max / total, 6) as pct_max from (select "window", {_P95('gib', 'used_p95')}, round(min(gib), 6) as used_min, avg(gib) as m, round(avg(gib), 6) as used_mean, round(max(gib), 6) as used_max, count(*) as n from ({MEMORY}) group by 1) u join (select "window", avg(v) / 1073741824.0 as total from s where metric = 'memory_total' group by 1) w on u."window" = w."window" """
add_points("a38_mem_stats", mo.mem_stats, MST)
CST = f"""select "window", {_P95('util', 'util_p95')}, round(avg(util), 6) as util_mean, round(max(util), 6) as util_max, round_even(avg(cores), 0)::bigint as cores, count(*) as n from cs group by 1"""
add_points("a39_cpu_stats", mo.cpu_stats, CPU + CST)
DST = f"""select u."window", round(m, 6) as used_mean, round(x, 6) as used_max, round(size, 6) as size, round(100 * m / size, 6) as pct_mean, round(100 * x / size, 6) as pct_max from (select "window", avg(gib) as m, max(gib) as x from ({DISK}) group by 1) u join (select "window", avg(v) / 1073741824.0 as size from s where metric = 'filesystem_size' group by 1) w on u."window" = w."window" """
add_points("a40_disk_stats", mo.disk_stats, DST)
add_points("a41_load_stats", mo.load_stats, f"""select "window", {_P95('v', 'p95')}, round(avg(v), 6) as mean, round(max(v), 6) as max from s where metric = 'load_1' group by 1""")
add_points("a41_bw_stats", mo.bw_stats, """select "window", substr(metric, 4) as direction, round(avg(v), 6) as mean, round(max(v), 6) as max from s where metric like 'bw%' group by all""")
add_points("a42_do_summary", mo.do_summary, CPU + f""", m as ({MST}), k as ({CST}), d as ({DST}) select coalesce(m."window", k."window", d."window") as "window", m.used_mean as mem_mean, m.used_max as mem_max, m.total as mem_total, util_mean, util_p95, cores, d.used_mean as disk_mean, d.used_max as disk_max, 99 as window_ord from m full join k on m."window" = k."window" full join d on d."window" = coalesce(m."window", k."window")""")
add_points("a63_mem_series", mo.mem_series, f'select "window", t, round(gib, 6) as gib from ({MEMORY})')
add_points("a63_disk_series", mo.disk_series, f'select "window", t, round(gib, 6) as gib from ({DISK})')
add_points("a63_cpu_series", lambda p: mo.cpu_steps(p).drop("cores"), CPU + 'select "window", t, round(util, 6) as util from cs')
_STARTS = lambda p: p.groupBy("window").agg(F.min("t").alias("t0"))
_T0 = '(select window_name as "window", min(t) as t0 from points group by 1)'
add_points("a64_mem_overlay", lambda p: mo.overlay(mo.mem_series(p), "gib", _STARTS(p)), f'select a."window", round((t - t0) / 3600, 6) as hour, round(gib, 6) as gib from ({MEMORY}) a join {_T0} z on a."window" = z."window"')
add_points("a64_cpu_overlay", lambda p: mo.overlay(mo.cpu_steps(p), "util", _STARTS(p)), CPU + f'select a."window", round((t - t0) / 3600, 6) as hour, round(util, 6) as util from cs a join {_T0} z on a."window" = z."window"')
add_points("a64_disk_overlay", lambda p: mo.overlay(mo.disk_series(p), "gib", _STARTS(p)), f'select a."window", round((t - t0) / 3600, 6) as hour, round(gib, 6) as gib from ({DISK}) a join {_T0} z on a."window" = z."window"')
add_points("a65_samples", mo.samples, 'select window_name as "window", metric, count(*) as samples from points group by all')


def _captures(p: DataFrame) -> DataFrame:
    """Four captures: shares of the whole span, and one outside."""
    span = p.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cut = F.explode(F.array(*(F.struct(F.lit(n).alias("capture"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("window")) for n, a, b, w in (("c1", 0.0, 0.5, "w0"), ("c2", 0.25, 1.5, "w1"), ("c3", 0.9, 1.0, "w2"), ("c4", 2.0, 3.0, "w0")))))
    return span.select("lo", "hi", cut.alias("c")).select("c.capture", "c.window", (F.col("lo") + F.col("c.a") * (F.col("hi") - F.col("lo"))).alias("t0"), (F.col("lo") + F.col("c.b") * (F.col("hi") - F.col("lo"))).alias("t1"))


_CAP = """, cap as (select capture, w as "window", lo + a * (hi - lo) as t0, lo + b * (hi - lo) as t1 from (select min(t) as lo, max(t) as hi from points), (values ('c1', 0.0::double, 0.5::double, 'w0'), ('c2', 0.25, 1.5, 'w1'), ('c3', 0.9, 1.0, 'w2'), ('c4', 2.0, 3.0, 'w0')) v(capture, a, b, w)) """
add_points("j11_window_for", lambda p: mo.window_for(p, _captures(p).drop("window")), _CAP + """, sp as (select "window" as w, min(t) as w0, max(t) as w1 from s where metric = 'memory_total' group by 1), z as (select capture, w, (least(t1, w1) - greatest(t0, w0))::double as o, row_number() over (partition by capture order by least(t1, w1) - greatest(t0, w0) desc, w) as k from cap join sp on w0 < t1 and w1 > t0) select capture, w as "window", round(o, 6) as overlap from z where k = 1""")
add_points("a60_coverage", lambda p: mo.coverage(p, _captures(p)), _CAP + """, i as (select capture, max(t) - min(t) as c from cap join s on cap."window" = s."window" and metric = 'memory_total' and t between t0 and t1 group by 1) select cap.capture, "window", round(coalesce(c, 0) / (t1 - t0), 6) as share, coalesce(c, 0) / (t1 - t0) < 0.9 as short from cap left join i on cap.capture = i.capture""")


def _runs(p: DataFrame) -> DataFrame:
    return _captures(p).where("capture in ('c1', 'c2')").selectExpr("case capture when 'c1' then 'before' else 'after' end side", "window", "t0", "t1")


add_points("a59_load_compare", lambda p: mo.load_compare(p, _runs(p)), CPU + _CAP + f""", ru as (select case capture when 'c1' then 'before' else 'after' end as side, "window", t0, t0 + (select min(t1 - t0) from cap where capture in ('c1', 'c2')) as e from cap where capture in ('c1', 'c2')),
 a as (select side, avg(util) as cpu from cs join ru on cs."window" = ru."window" and t between t0 and e group by 1), b as (select side, avg(gib) as mem from ({MEMORY}) m join ru on m."window" = ru."window" and t between t0 and e group by 1),
 z as (select max(cpu) filter (side = 'before') as cb, max(cpu) filter (side = 'after') as ca from a), y as (select max(mem) filter (side = 'before') as mb, max(mem) filter (side = 'after') as ma from b), co as (select round_even(avg(cores), 0) as cores from cs where "window" = 'w0')
 select round(cb, 6) as cpu_before, round(mb, 6) as mem_before, round(ca, 6) as cpu_after, round(ma, 6) as mem_after, cores::bigint as cores, round((ca - cb) / 100 * cores, 6) as cores_delta, round(ma - mb, 6) as mem_delta from z, y, co""")


add_points("a59_load_frames", lambda p: mo.load_frames(p, _runs(p)), CPU + _CAP + f""", ru as (select case capture when 'c1' then 'before' else 'after' end as side, "window", t0, t0 + (select min(t1 - t0) from cap where capture in ('c1', 'c2')) as e from cap where capture in ('c1', 'c2')),
 b as (select "window", t, 'cpu' as metric, util as value from cs union all select "window", t, 'mem', gib from ({MEMORY})) select side, metric, round((t - t0) / 3600, 6) as hour, round(value, 6) as value from b join ru on b."window" = ru."window" where t between t0 and e""")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice") * F.col("l_quantity")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"), F.col("l_extendedprice").alias("w"), F.col("l_quantity").alias("q"), (F.pmod("l_partkey", F.lit(3)) == 0).alias("tie"))
    change, load = x.pct_change(F.col("w"), F.col("v")), F.col("q")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", x.human(F.col("v")).alias("human"), x.human_calls(F.col("v")).alias("calls"), x.ms_label(F.col("q") / 3).alias("ms"), x.binary_label(F.col("v") * F.col("q")).alias("bytes"),
        x.delta_label(F.col("w"), F.col("w") + F.col("q") * 41, F.col("tie")).alias("delta"), x.verdict_higher_better(F.col("q") - 25).alias("higher"), x.verdict_vs_load(F.col("q") - 3, load * 0 + 30).alias("vs_load"),
    ).distinct()


QUERIES["f12_labels"] = _labelled
_BIN = "case " + " ".join(f"when b < power(1024, {k + 1}) then printf('%.1f{n}', b / power(1024, {k}))" for k, n in enumerate(("B", "KB", "MB", "GB"))) + " else printf('%.1fTB', b / power(1024, 4)) end"
_DTXT = "case when abs(y - w) >= 1000 then printf('%.2f s', abs(y - w) / 1000) else printf('%.2f ms', abs(y - w)) end"
SQL["f12_labels"] = f"""with r as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_quantity as v, l_extendedprice as w, l_quantity as q, l_partkey % 3 = 0 as tie, l_extendedprice * l_quantity * l_quantity as b, l_extendedprice + l_quantity * 41 as y from lineitem)
 select distinct l_orderkey, l_linenumber, l_partkey, {_human('v', True)} as human, {_human('v', False)} as calls, {_ms('(q / 3)')} as ms, {_BIN} as bytes, case when tie then '≈ equivalent (' || {_DTXT} || ')' else {_DTXT} || case when y < w then ' faster' else ' slower' end end as delta,
 case when abs(q - 25) < 3 then 'same' when q > 25 then 'better' else 'worse' end as higher, case when q - 3 <= 3 then 'better' when q - 3 <= 15 then 'better' when q - 3 <= 30 then 'close' else 'worse' end as vs_load from r"""


# ---- pairing: a user's clicks are requests, views responses
def _pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("conn"), "event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"))
    number = (F.row_number().over(Window.partitionBy("conn").orderBy("ts", "event_id")) - 1).cast("long")
    req, resp = (e.where(F.col("event_type") == k).withColumn(n, number).select("conn", n, "ts") for k, n in (("click", "i"), ("view", "k")))
    return _rounded(rp.scrub(rp.pair_responses(req, resp), 3_600_000.0))


QUERIES["x5_pairing"] = _pairing
SQL["x5_pairing"] = """with recursive e as (select user_id as conn, event_type, epoch(ts) as ts, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as n from events where event_type in ('click', 'view')),
 rq as (select conn, n as i, ts from e where event_type = 'click'), rs as (select conn, n as k, ts from e where event_type = 'view'),
 step as (select rq.conn, rq.i, rq.ts, (select count(*) from rs where rs.conn = rq.conn and rs.ts < rq.ts) as k from rq where i = 0
   union all select rq.conn, rq.i, rq.ts, greatest(step.k + 1, (select count(*) from rs where rs.conn = rq.conn and rs.ts < rq.ts)) from step join rq on rq.conn = step.conn and rq.i = step.i + 1),
 z as (select step.conn, step.i, step.ts, rs.k, (rs.ts - step.ts) * 1000 as d from step left join rs on rs.conn = step.conn and rs.k = step.k)
 select conn, i, round(ts, 6) as ts, case when d > 3600000 then null else k end as k, round(case when d > 3600000 then null else d end, 6) as duration_ms, coalesce(d > 3600000, false) as scrubbed from z"""


# ---- capture quality: an event is a flow; its value is the declared length, and some bodies and answers are missing
def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id as flow_id", "case when event_type = 'error' then null when event_type = 'signup' then 'GET' else 'POST' end as http_method", "cast(floor(value) as long) as declared",
        "cast(case when event_id % 7 < 3 then 0 else floor(value) + 1 end as long) as body_bytes", "event_id % 2 = 0 as served", "event_id % 5 = 0 as upstream",
        "case when user_id % 11 = 0 then '' else concat('agent', user_id % 5, ' v1') end as user_agent", "unix_micros(cast(ts as timestamp)) / 1e6D as ts_start",
    )


_FACTS = """f as (select event_id, case when event_type = 'error' then 'non_http' when event_type = 'signup' then 'non_post' when event_id % 7 >= 3 then 'delivered' when floor(value) = 0 then 'empty_ok' when event_id % 2 = 0 then 'capture_gap' else 'aborted' end as class,
 event_id % 5 = 0 as upstream, case when user_id % 11 = 0 then '<none>' else 'agent' || (user_id % 5) end as user_agent, floor(epoch(ts) / 3600)::bigint as hour from events)"""


def add_health(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    from ..sources.mitm import classified

    QUERIES[name] = lambda spark, d: _rounded(make(classified(_facts(spark, d))))
    SQL[name] = f"with {_FACTS} {sql}"


def _health() -> None:
    from ..sources import mitm

    classes = ("delivered", "aborted", "capture_gap", "empty_ok", "non_post", "non_http")
    n = ", ".join(f"count(*) filter (class = '{c}') as {c}" for c in classes)
    add_health("a36_health", mitm.health, f", z as (select {n}, count(*) filter (class = 'aborted' and upstream) as aborted_upstream from f), y as (select *, delivered + aborted + capture_gap + empty_ok as posts from z) select * exclude (posts), round(delivered / (delivered + aborted + capture_gap) * 100, 6) as delivered_pct, round(capture_gap / posts * 100, 6) as gap_pct, capture_gap / posts * 100 < 1 as verdict from y")
    three = ", ".join(f"count(*) filter (class = '{c}') as {c}" for c in classes[:3])
    for what in ("user_agent", "hour"):
        add_health(f"a36_health_by_{what}", lambda c, w=what: mitm.health_by(c, w), f"select {what}, count(*) as flows, {three}, round(count(*) filter (class = 'delivered') / count(*) * 100, 6) as delivered_pct from f where class in ('delivered', 'aborted', 'capture_gap') group by 1" + (" order by flows desc, user_agent limit 12" if what == "user_agent" else ""))


_health()


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.pcap import truncation_report

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _rounded(truncation_report(o.selectExpr(
        "cast(o_custkey as string) as src", "'POST' as method", "'/' as path", "cast(case when o_orderkey % 9 = 0 then 0 else 1000 end as long) as declared",
        "cast(case o_orderpriority when '1-URGENT' then 0 else o_orderkey % 2000 end as long) as body_seen", "o_orderkey % 13 <> 0 as headers_complete", "case o_orderstatus when 'F' then 'FIN' when 'O' then 'RST' else 'none' end as close",
    )))


QUERIES["a37_truncation_report"] = _truncated
SQL["a37_truncation_report"] = """with r as (select case when o_orderkey % 9 = 0 then 0 else 1000 end as d, case o_orderpriority when '1-URGENT' then 0 else o_orderkey % 2000 end as b, o_orderkey % 13 <> 0 as h, case o_orderstatus when 'F' then 'FIN' when 'O' then 'RST' else 'none' end as c from orders),
 z as (select *, h and d > 0 as have, h and d > 0 and b < d as cut from r) select count(*) as connections, count(*) filter (not h) as no_header, count(*) filter (have) as requests, count(*) filter (have and not cut) as complete, count(*) filter (cut) as truncated, count(*) filter (cut and b = 0) as zero, count(*) filter (cut and b > 0) as partial,
 count(*) filter (cut and c = 'RST') as closed_rst, count(*) filter (cut and c = 'FIN') as closed_fin, count(*) filter (cut and c = 'none') as closed_none, round(count(*) filter (cut) / count(*) filter (have), 6) as truncated_share, count(*) filter (cut) / count(*) filter (have) >= 0.5 as verdict from z"""

from . import ingest  # noqa: E402

SQL["u4_truncation_of_captures"] = SQL["a37_truncation_report"]
QUERIES |= ingest.QUERIES
SQL |= ingest.SQL
