"""Queries that write the driver's tables as dumps, captures and monitoring responses and read them back, with SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import monitoring as mo, replay as rp
from ..schema import CALLS_SCHEMA
from ..sources import mitm, pcap, series
from . import bridge, fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BANNED = "10.0.0.3"

_LINES = bridge.CALLS_SQL.split(" union all ")[0] + ")"
_Q = """'{"id":' || position || ',"method":"' || method || '"' || coalesce(',"params":' || params_json, '') || '}'"""
_A = """'{"id":' || position || coalesce(',"result":' || result_json, ',"error":{"code":' || error_code || ',"message":"' || error_message || '","data":[' || position || ']}', '') || '}'"""
BODIES_SQL = f"""{_LINES}, items as (select flow_id, position, batch_size, {_Q} as q, {_A} as a from calls),
 bodies as (select flow_id, case when max(batch_size) = 1 then min(q) else '[' || string_agg(q, ',' order by position) || ']' end as request, case when max(batch_size) = 1 then min(a) else '[' || string_agg(a, ',' order by position desc) || ']' end as response from items group by flow_id)"""
_COLUMNS = [f.name for f in CALLS_SCHEMA if f.name != "flow_id"]
_ROUND = {"ts_start", "duration_ms"}


def _calls_sql(start: str, took: str, status: str, whole: str, where: str) -> str:
    """Columns of calls; whole tells whether the flow has its answer."""
    told = {
        "ts_start": f"round({start}, 6)", "duration_ms": f"round({took}, 6)", "http_status": status, "host": "'node'", "path": "'/o/' || c.flow_id", "rpc_id": "position::varchar",
        **{k: f"case when {whole} then {k} end" for k in ("result_json", "error_code", "error_message")}, "error_data_json": f"case when {whole} and error_code is not null then '[' || position || ']' end",
        "flow_req_bytes": "length(request)::bigint", "flow_resp_bytes": f"case when {whole} then length(response) else 0 end::bigint",
    }
    return f"with {BODIES_SQL} select " + ", ".join(f"{told.get(k, k)} as {k}" for k in _COLUMNS) + f" from calls c join bodies b on c.flow_id = b.flow_id where {where}"


def _rows(calls: DataFrame) -> DataFrame:
    return calls.select(*(F.round(k, 6).alias(k) if k in _ROUND else F.col(k) for k in _COLUMNS))


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(mitm.convert(spark, fx.dumps(spark, sf_dir), banned=(BANNED,)))


QUERIES["u1_convert_dumps"] = _dump
SQL["u1_convert_dumps"] = _calls_sql("ts_start", "((ts_start + duration_ms / 1000) - ts_start) * 1000", "http_status", "http_status is not null", "c.flow_id % 13 >= 6 and c.flow_id % 5 <> 3")


def _capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(pcap.convert(spark, fx.captures(spark, sf_dir), "", fx.PORT, banned=(BANNED,)))


QUERIES["u2_convert_captures"] = _capture
_FAST = "c.flow_id % 90 + 0.25 <= 60"
SQL["u2_convert_captures"] = _calls_sql(
    f"(1e9 + (dense_rank() over (partition by c.flow_id % {fx.CONNECTIONS} order by c.flow_id) - 1) * {fx.GAP})", f"case when {_FAST} then (c.flow_id % 90 + 0.25)::double * 1000 end",
    f"case when {_FAST} then case when c.flow_id % 6 = 0 then 500 else 200 end end", _FAST, "true",
)
# the rank counts banned flows too; they go afterwards
SQL["u2_convert_captures"] = f"select * from ({SQL['u2_convert_captures']}) where substr(path, 4)::bigint % 5 <> 3"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of flows: from 1, without a gap, in the order in which connections end."""
    calls = pcap.convert(spark, fx.captures(spark, sf_dir), "", fx.PORT)
    return calls.agg(F.min("flow_id").alias("first"), F.max("flow_id").alias("last"), F.countDistinct("flow_id").alias("flows"), F.countDistinct("path").alias("paths"))


QUERIES["x3_capture_flow_ids"] = _numbers
SQL["x3_capture_flow_ids"] = f"with {_LINES} select 1::bigint as first, count(distinct flow_id) as last, count(distinct flow_id) as flows, count(distinct flow_id) as paths from calls"


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mitm.health(mitm.classified(mitm.flow_facts(spark, fx.dumps(spark, sf_dir))))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


_CLASS = "case flow_id % 13 when 1 then 'non_post' when 2 then 'aborted' when 3 then 'capture_gap' when 4 then 'empty_ok' when 5 then 'non_http' else 'delivered' end"
QUERIES["u3_health_of_dumps"] = _health
SQL["u3_health_of_dumps"] = (
    f"with {_LINES}, f as (select distinct flow_id, {_CLASS} as class from calls), z as (select " + ", ".join(f"count(*) filter (class = '{c}') as {c}" for c in ("delivered", "aborted", "capture_gap", "empty_ok", "non_post", "non_http"))
    + ", count(*) filter (class = 'aborted' and flow_id % 2 = 0) as aborted_upstream from f) select *, round(delivered / (delivered + aborted + capture_gap) * 100, 6) as delivered_pct, round(capture_gap / (delivered + aborted + capture_gap + empty_ok) * 100, 6) as gap_pct, capture_gap / (delivered + aborted + capture_gap + empty_ok) * 100 < 1 as verdict from z"
)


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.flow_counters(mitm.flow_facts(spark, fx.dumps(spark, sf_dir)))


QUERIES["a43_flow_counters"] = _counters
SQL["a43_flow_counters"] = f"with {_LINES}, f as (select flow_id, max(batch_size) as n, flow_id % 13 as k from calls group by flow_id) select count(*) filter (k <> 5) as flows, count(*) filter (k = 1) as non_post, count(*) filter (k in (0, 2, 3, 4)) as parse_failures, count(*) filter (k > 5) as post_parsed, (sum(n) filter (k > 5))::bigint as calls from f"


def _truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pcap.truncation_report(pcap.truncation(pcap.packets_of(spark, fx.cut_captures(spark, sf_dir), fx.PORT), fx.PORT))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


QUERIES["u4_truncation_of_captures"] = _truncation


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = fx.folder(spark, "series")
    fx.write_points(bridge.points(spark, sf_dir), to)
    return series.points(spark, to)


QUERIES["s9_monitoring_files"] = lambda spark, d: _monitored(spark, d).select("window", "metric", "mode", "t", "v", "ordinal")
SQL["s9_monitoring_files"] = f"with {bridge.POINTS_SQL} select window_name as \"window\", metric, case when metric = 'cpu' then mode else '' end as mode, t, v, row_number() over (partition by window_name, metric, mode order by ordinal, t) - 1 as ordinal from points"

QUERIES["s10_windows"] = lambda spark, d: series.windows(_monitored(spark, d))
SQL["s10_windows"] = f"with {bridge.POINTS_SQL} select distinct window_name as \"window\", 99 as window_ord from points"

QUERIES["s12_capture_window"] = lambda spark, d: series.capture_window(bridge.calls(spark, d))
SQL["s12_capture_window"] = f"with {bridge.CALLS_SQL} select floor(min(ts_start))::bigint - 300 as start, floor(max(ts_start))::bigint + 300 as \"end\" from calls"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    stem = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("calls-"), F.date_format(F.date_add("d", 40), "yy-MM-dd"), F.lit("-x"))).otherwise(F.lit("calls-99-13-45"))
    return o.select("o_orderkey", series.label_for(stem, F.unix_timestamp("d")).alias("label"))


QUERIES["s13_labels"] = _labels
SQL["s13_labels"] = "select o_orderkey, lower(strftime(case when o_orderkey % 2 = 0 then o_orderdate::date + 40 else o_orderdate::date end, '%b%d')) as label from orders"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by the order of their names; others come last."""
    names = F.create_map(*map(F.lit, ("w0", "now24h", "w1", "may22", "w2", "other")))
    p = bridge.points(spark, sf_dir).withColumn("window", names[F.col("window")])
    return mo.do_summary(p).select("window", "window_ord")


QUERIES["t9_window_order"] = _ordered
SQL["t9_window_order"] = "select * from (values ('may22', 1), ('now24h', 3), ('other', 99)) as t(\"window\", window_ord)"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written with each compression and read back."""
    calls, out = bridge.calls(spark, sf_dir, wide=False), None
    for kind in ("zstd", "snappy", "gzip", "none"):
        at = fx.folder(spark, "calls")
        mitm.write_calls(calls, at, kind, row_group_bytes=1 << 20)
        one = spark.read.parquet(at).agg(F.lit(kind).alias("compression"), F.count("*").alias("calls"), F.countDistinct("flow_id").alias("flows"), F.sum("flow_resp_bytes").alias("bytes"), F.max("params_json").alias("params"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["k1_written_calls"] = _written
SQL["k1_written_calls"] = f"with {_LINES} select c.compression, count(*) as calls, count(distinct flow_id) as flows, sum(flow_resp_bytes)::bigint as bytes, max(params_json) as params from calls, (values ('zstd'), ('snappy'), ('gzip'), ('none')) c(compression) group by 1"
