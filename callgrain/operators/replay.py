"""The report over replayed flows: counters, latency by the floor(n * p) rule, errors and their samples. It works on the calls table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import exprs as x
from . import traffic as t

P3 = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def counters(calls: DataFrame) -> DataFrame:
    per = t.flows(calls, "http_status").agg(F.count("*").alias("flows"), F.count_if(F.col("http_status") >= 400).alias("http_errors"))
    return calls.agg(F.count("*").alias("calls"), F.count("error_code").alias("rpc_errors"), F.countDistinct("method").alias("methods")).join(F.broadcast(per), F.lit(True), "left")


def batch_sizes(calls: DataFrame) -> DataFrame:
    return t.flows(calls, "batch_size").groupBy("batch_size").agg(F.count("*").alias("flows"))


def method_counts(calls: DataFrame, n: int = 20) -> DataFrame:
    return calls.groupBy("method").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "method").limit(n)


def latency_by_bucket(calls: DataFrame) -> DataFrame:
    per = t.flows(calls, "batch_size", "duration_ms").where("duration_ms is not null").withColumn("bucket", x.replay_bucket(F.col("batch_size")))
    return x.with_quantiles(per, ["bucket"], "duration_ms", "floor_np", P3, {"flows": "rows", "max": "max"})


def latency_overall(calls: DataFrame) -> DataFrame:
    per = t.flows(calls, "duration_ms").where("duration_ms is not null").select(F.lit("overall").alias("bucket"), "duration_ms")
    return x.with_quantiles(per, ["bucket"], "duration_ms", "floor_np", P3, {"flows": "rows", "max": "max"})


def body_sizes(calls: DataFrame) -> DataFrame:
    per = t.flows(calls, "flow_req_bytes", "flow_resp_bytes").selectExpr("stack(2, 'request', flow_req_bytes, 'response', flow_resp_bytes) as (body, bytes)").where("bytes is not null")
    return x.with_quantiles(per, ["body"], "bytes", "floor_np", {"p50": 0.5, "p95": 0.95}, {"flows": "rows", "max": "max", "total": "sum"})


def methods(calls: DataFrame, n: int = 30) -> DataFrame:
    """The methods called most: calls, how many of them alone, and the latency of those."""
    top = calls.groupBy("method").agg(F.count("*").alias("calls"), F.count_if(F.col("batch_size") == 1).alias("singles")).orderBy(F.desc("calls"), "method").limit(n)
    alone = x.with_quantiles(calls.where("batch_size = 1 and duration_ms is not null"), ["method"], "duration_ms", "floor_np", P3, {})
    return top.join(alone, "method", "left")


def error_codes(calls: DataFrame) -> DataFrame:
    """Calls by JSON-RPC error code."""
    return calls.where("error_code is not null").groupBy("error_code").agg(F.count("*").alias("calls"))


def status_errors(calls: DataFrame) -> DataFrame:
    """Flows by HTTP status, of 400 and above."""
    return t.flows(calls, "http_status").where("http_status >= 400").groupBy("http_status").agg(F.count("*").alias("flows"))


def slowest_flows(calls: DataFrame, n: int = 20) -> DataFrame:
    """The slowest flows with their first method and their size; equal durations by flow."""
    per = t.flows(calls, "method", "duration_ms", "batch_size", "flow_req_bytes", "flow_resp_bytes").where("duration_ms is not null")
    return per.orderBy(F.desc("duration_ms"), "flow_id").limit(n)


def flow_counters(facts: DataFrame) -> DataFrame:
    """Of flows as a dump has them (http_method, parsed, calls): all, those that aren't POST, those whose body is no JSON, the others and their calls."""
    post = F.col("http_method") == "POST"
    return facts.where("http_method is not null").agg(
        F.count("*").alias("flows"), F.count_if(~post).alias("non_post"), F.count_if(post & ~F.col("parsed")).alias("parse_failures"),
        F.count_if(post & F.col("parsed")).alias("post_parsed"), F.coalesce(F.sum(F.when(post & F.col("parsed"), F.col("calls"))), F.lit(0)).alias("calls"),
    )


def slowest_methods(calls: DataFrame, least: int = 10, n: int = 15) -> DataFrame:
    held = calls.where("batch_size = 1 and duration_ms is not null")
    out = x.with_quantiles(held, ["method"], "duration_ms", "floor_np", P3, {"n": "rows"})
    return out.where(F.col("n") >= least).orderBy(F.desc("p95"), "method").limit(n)


def errors_by_method(calls: DataFrame, n: int = 20) -> DataFrame:
    """Methods with the most errors, their share, and `code:count` by falling count."""
    by_code = calls.groupBy("method", "error_code").agg(F.count("*").alias("c"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error_code").isNotNull(), F.struct((-F.col("c")).alias("k"), F.col("error_code").alias("code"))))), lambda s: F.concat_ws(":", s["code"].cast("string"), (-s["k"]).cast("string"))), ",")
    out = by_code.groupBy("method").agg(F.sum("c").alias("calls"), F.coalesce(F.sum(F.when(F.col("error_code").isNotNull(), F.col("c"))), F.lit(0)).alias("errors"), codes.alias("codes"))
    return out.where("errors > 0").withColumn("err_pct", F.col("errors") / F.col("calls") * 100).orderBy(F.desc("errors"), "method").limit(n)


def error_samples(calls: DataFrame, samples: int = 3, pairs: int = 8) -> DataFrame:
    """The first samples, in flow order, of the commonest (method, code) pairs."""
    failed = calls.where("error_code is not null")
    top = failed.groupBy("method", "error_code").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "method", "error_code").limit(pairs)
    rank = Window.partitionBy("method", "error_code").orderBy("flow_id", "position")
    kept = failed.join(F.broadcast(top), ["method", "error_code"]).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= samples)  # top has at most `pairs` rows
    return kept.select("method", "error_code", F.col("c").alias("count"), "k", "flow_id", "position", "error_message", "params_json")


def flows_with_method(calls: DataFrame, method: str, n: int = 20) -> DataFrame:
    """The slowest flows that hold a call of the method; equal durations by flow."""
    held = calls.groupBy("flow_id").agg(F.bool_or(F.col("method") == method).alias("holds"), F.max("duration_ms").alias("duration_ms"), F.max("batch_size").alias("batch_size"), F.count("*").alias("calls"))
    return held.where("holds and duration_ms is not null").orderBy(F.desc("duration_ms"), "flow_id").limit(n).drop("holds")


def pair_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """First unconsumed response at or after each request, by connection: requests (conn, i, ts) and responses (conn, k, ts), numbered from 0
    with starts that don't fall, to (conn, i, ts, k, duration_ms); k is null without an answer.

    With f responses before request i starts, the greedy pointer is i + max over j <= i of (f_j - j): two window sums over a connection.
    """
    both = requests.select("conn", "ts", F.lit(0).alias("kind"), F.col("i").alias("idx")).unionByName(responses.select("conn", "ts", F.lit(1).alias("kind"), F.col("k").alias("idx")))
    order = Window.partitionBy("conn").orderBy("ts", "kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("f", F.sum("kind").over(order)).where("kind = 0")
    pointer = Window.partitionBy("conn").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    told = numbered.select("conn", F.col("idx").alias("i"), F.col("ts").alias("t"), (F.col("idx") + F.max(F.col("f") - F.col("idx")).over(pointer)).alias("k"))
    out = told.join(responses.select("conn", "k", F.col("ts").alias("answered")), ["conn", "k"], "left")
    return out.select("conn", "i", F.col("t").alias("ts"), F.when(F.col("answered").isNotNull(), F.col("k")).alias("k"), ((F.col("answered") - F.col("t")) * 1000).alias("duration_ms"))


def scrub(pairs: DataFrame, most_ms: float | None = 60_000.0) -> DataFrame:
    """Implausible pairs keep their row and lose the answer."""
    bad = F.col("duration_ms") < 0
    if most_ms:
        bad = bad | (F.col("duration_ms") > most_ms)
    return pairs.withColumn("scrubbed", F.coalesce(bad, F.lit(False))).withColumn("k", F.when(~F.col("scrubbed"), F.col("k"))).withColumn("duration_ms", F.when(~F.col("scrubbed"), F.col("duration_ms")))
