"""The driver's tables as traffic: an order is a flow and a line item a call; users' events and suppliers' lines are larger batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One text for both dialects; {epoch} is the only difference. The order of lines within an order is unique at every scale.
_LINES = """
select l_orderkey as flow_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 as int) as position,
  cast(count(*) over (partition by l_orderkey) as int) as batch_size,
  {epoch_order} as ts_start,
  case when o_orderstatus = 'P' then null else o_totalprice end as duration_ms,
  case o_orderstatus when 'F' then 200 when 'O' then 500 end as http_status,
  case when p_size = 1 then p_brand when p_type like 'MEDIUM%' then 'eth_' || p_brand when p_type like 'STANDARD%' then 'Filecoin.' || p_brand when p_type like 'LARGE%' then 'trace_' || p_brand
    when p_type like 'PROMO%' then 'F3.' || p_brand when p_type like 'SMALL%' then 'net_' || p_brand else 'web3_' || p_brand end as method,
  case when l_quantity > 40 then null else '[' || cast(l_suppkey % 7 as varchar(20)) || ']' end as params_json,
  case when o_orderstatus <> 'P' and l_returnflag = 'N' then '{{}}' end as result_json,
  case when o_orderstatus <> 'P' and l_returnflag = 'R' then cast(-32000 - l_linenumber as bigint) end as error_code,
  case when o_orderstatus <> 'P' and l_returnflag = 'R' then case when l_linenumber = 2 then 'execution failed: ' else 'error ' end || l_linestatus end as error_message,
  cast(100 + l_orderkey % 900 as bigint) as flow_req_bytes,
  cast(floor(o_totalprice) as bigint) as flow_resp_bytes
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
"""
_USERS = """
select 1000000000 + user_id as flow_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as position, cast(count(*) over (partition by user_id) as int) as batch_size,
  {epoch_user} as ts_start,
  case when user_id % 10 = 0 then null else user_id * 37.25e0 + 11 end as duration_ms, case when user_id % 10 = 0 then null else 200 end as http_status,
  'eth_' || event_type as method, cast(null as varchar(20)) as params_json, case when event_type <> 'error' and user_id % 10 <> 0 then '1' end as result_json,
  cast(null as bigint) as error_code, cast(null as varchar(20)) as error_message, cast(200 + user_id as bigint) as flow_req_bytes, cast(3000 + user_id as bigint) as flow_resp_bytes
from events
"""
_SUPPLIERS = """
select 2000000000 + l_suppkey as flow_id, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity) - 1 as int) as position,
  cast(count(*) over (partition by l_suppkey) as int) as batch_size,
  {epoch_ship} as ts_start, l_suppkey * 101.5e0 as duration_ms, 200 as http_status, 'eth_call' as method, '[' || cast(l_linenumber as varchar(20)) || ']' as params_json, '1' as result_json,
  cast(null as bigint) as error_code, cast(null as varchar(20)) as error_message, cast(500 as bigint) as flow_req_bytes, cast(7000 + l_suppkey as bigint) as flow_resp_bytes
from lineitem
"""
_SINGLE_CALLS = """
select 3000000000 + s_suppkey as flow_id, 0 as position, 1 as batch_size, cast(800000000 + s_suppkey * 60 as double) as ts_start, s_suppkey * 3.5e0 + 20 as duration_ms, 200 as http_status, 'eth_call' as method,
  '[]' as params_json, '1' as result_json, cast(null as bigint) as error_code, cast(null as varchar(20)) as error_message, cast(300 as bigint) as flow_req_bytes, cast(400 + s_suppkey as bigint) as flow_resp_bytes
from supplier
"""
_DUCK = {"epoch_order": "epoch(o_orderdate)", "epoch_user": "min(epoch(ts)) over (partition by user_id)", "epoch_ship": "min(epoch(l_shipdate)) over (partition by l_suppkey)"}
_SPARK = {
    "epoch_order": "unix_micros(cast(o_orderdate as timestamp)) / 1e6D",
    "epoch_user": "min(unix_micros(cast(ts as timestamp)) / 1e6D) over (partition by user_id)",
    "epoch_ship": "min(unix_micros(cast(l_shipdate as timestamp)) / 1e6D) over (partition by l_suppkey)",
}
#: The common table expression `calls` for DuckDB.
CALLS_SQL = "calls as (" + " union all ".join(x.format(**_DUCK) for x in (_LINES, _USERS, _SUPPLIERS, _SINGLE_CALLS)) + ")"
#: Before and after: calls that start before or from this second.
HALF = 852076800


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def calls(spark: SparkSession, sf_dir: str, wide: bool = True) -> DataFrame:
    """The calls view; wide adds the larger batches, as all queries use it."""
    tables = _tables(spark, sf_dir, "lineitem", "orders", "part", "events", "supplier")
    out = None
    for text in (_LINES, _USERS, _SUPPLIERS, _SINGLE_CALLS) if wide else (_LINES,):
        # {name} refers to a DataFrame argument of spark.sql()
        sql = text.format(**_SPARK)
        for t in tables:
            sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
        sql = sql.replace("'{}'", "concat(char(123), char(125))")
        part = spark.sql(sql, **{t: d for t, d in tables.items() if f"{{{t}}}" in sql})
        out = part if out is None else out.unionByName(part)
    return out


def before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = calls(spark, sf_dir)
    return c.where(f"ts_start < {HALF}"), c.where(f"ts_start >= {HALF}")


# Monitoring: an event type is a CPU mode, its running count in a user's third of the users a counter; a window is user_id modulo 3.
POINTS_SQL = """e as (select 'w' || (user_id % 3) as window_name, cast(floor(epoch(ts) / 3600) * 3600 as bigint) as t, event_type as mode, event_id from events),
g as (select window_name, t, mode, count(*) as k, max(event_id) as m from e group by all),
points as (
  select window_name, 'cpu' as metric, case mode when 'view' then 'idle' else mode end as mode, t, cast(sum(k) over (partition by window_name, mode order by t) as double) - case when m % 97 = 0 then 50 else 0 end as v, m as ordinal from g
  union all select window_name, 'memory_total', '', t, cast(64 * 1073741824::bigint as double), max(m) from g group by window_name, t
  union all select window_name, 'memory_available', '', t, cast(sum(k) * 1073741824::bigint as double), max(m) from g where t % 7 <> 0 group by window_name, t
  union all select window_name, 'filesystem_size', '', t, cast(512 * 1073741824::bigint as double), max(m) from g group by window_name, t
  union all select window_name, 'filesystem_free', '', t, cast((max(m) % 400) * 1073741824::bigint as double), max(m) from g group by window_name, t
  union all select window_name, 'load_1', '', t, cast(sum(k) as double) / 4, max(m) from g group by window_name, t
  union all select window_name, 'bw_inbound', '', t, cast(max(m) % 1000 as double), max(m) from g group by window_name, t
  union all select window_name, 'bw_outbound', '', t, cast(max(m) % 777 as double), max(m) from g group by window_name, t)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "with " + POINTS_SQL.replace("epoch(ts)", "unix_micros(cast(ts as timestamp)) / 1000000").replace("from events", "from {events}").replace("group by all", "group by window_name, t, mode").replace("1073741824::bigint", "1073741824L")
    return spark.sql(sql + " select window_name as window, metric, mode, t, v, ordinal from points", **_tables(spark, sf_dir, "events"))
