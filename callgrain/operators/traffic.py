"""Queries over the calls table: latency, batches, coverage, errors, summaries, comparisons. DataFrame in, DataFrame out.

Flow columns repeat on a flow's rows; where one row a flow is wanted, it is the row with the lowest position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exprs as x

Q3 = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def singles(calls: DataFrame) -> DataFrame:
    return calls.where("batch_size = 1")


def without(calls: DataFrame, exclude: list[str] | None) -> DataFrame:
    return calls.where(~F.col("method").isin(exclude)) if exclude else calls


def flows(calls: DataFrame, *columns: str) -> DataFrame:
    """One row a flow with flow-level columns; they are equal on all its rows, so partial aggregation keeps any of the lowest position. Where
    calls tell a side, flows of each are apart."""
    by = ["side", "flow_id"] if "side" in calls.columns else ["flow_id"]
    first = F.min(F.struct("position", *columns)).alias("f")
    return calls.groupBy(*by).agg(first).select(*by, *(F.col(f"f.{c}").alias(c) for c in columns))


# ---- latency ---------------------------------------------------------------------------------------------------------


def singleton_per_method(calls: DataFrame) -> DataFrame:
    by = ["side", "method"] if "side" in calls.columns else ["method"]
    return x.with_quantiles(singles(calls), by, "duration_ms", "linear", Q3, {"n": "rows", "mean": "mean", "max": "max"})


def singleton_overall(calls: DataFrame) -> DataFrame:
    held = singles(calls).where("duration_ms is not null")
    return x.with_quantiles(held, [], "duration_ms", "linear", {"p50": 0.5, "p95": 0.95}, {"n": "rows", "mean": "mean"})


def top_singleton_methods(calls: DataFrame, n: int = 10) -> DataFrame:
    return singles(calls).groupBy("method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method").limit(n)


def batch_flows(calls: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    per = flows(without(calls, exclude).where("batch_size > 1"), "batch_size", "duration_ms")
    return per.withColumn("per_call_ms", F.col("duration_ms") / F.col("batch_size")).withColumn("bucket", x.batch_bucket(F.col("batch_size")))


def summarise_buckets(per: DataFrame, value: str, rule: str = "linear", by: tuple[str, ...] = ("bucket",), more: dict[str, str] | None = None) -> DataFrame:
    return x.with_quantiles(per, list(by), value, rule, Q3, {"flows": "rows", "mean": "mean"} | (more or {}))


def overall_latency(calls: DataFrame, rule: str = "linear", views: tuple[str, str] = ("per-flow", "per-call")) -> DataFrame:
    by = ["side", "view"] if "side" in calls.columns else ["view"]
    return x.with_quantiles(viewed(calls, views), by, "v", rule, Q3, {"avg": "mean"}, times="c")


def viewed(calls: DataFrame, views: tuple[str, str] = ("flow", "call")) -> DataFrame:
    """(side if calls tell one, view, method, v, c times) of flows, with their first method, and of calls, with their share of the flow's time;
    those without a duration are left out. Calls are counted by flow and method first, so both views come from one pass over them."""
    by = ["side"] if "side" in calls.columns else []
    held = calls.where("duration_ms is not null").groupBy(*by, "flow_id", "method", "duration_ms", "batch_size").agg(F.count("*").alias("c"), F.min("position").alias("position"))
    first = held.groupBy(*by, "flow_id").agg(F.min(F.struct("position", "method", "duration_ms")).alias("f"))
    flow = first.select(*by, F.lit(views[0]).alias("view"), F.col("f.method").alias("method"), F.col("f.duration_ms").alias("v"), F.lit(1).cast("long").alias("c"))
    each = held.select(*by, F.lit(views[1]).alias("view"), "method", (F.col("duration_ms") / F.col("batch_size")).alias("v"), "c")
    return flow.unionByName(each)


def per_flow_frame(calls: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """duration and first remaining method of each flow with a duration."""
    kept = without(calls, exclude).where("duration_ms is not null")
    return flows(kept, "method", "duration_ms").select("flow_id", "method", F.col("duration_ms").alias("v"))


def per_call_frame(calls: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    kept = without(calls, exclude).where("duration_ms is not null")
    return kept.select("method", (F.col("duration_ms") / F.col("batch_size")).alias("v"))


# ---- mix-normalised comparison ---------------------------------------------------------------------------------------


def ref_shares(a: DataFrame, b: DataFrame) -> DataFrame:
    counts = a.select("method").unionByName(b.select("method")).groupBy("method").agg(F.count("*").alias("c"))
    return counts.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy())).select("method", "share")


def reweighted(frame: DataFrame, by: list[str], pool: list[str]) -> DataFrame:
    """For each group of `by` the mean and lower weighted quantiles of v, each row of frame (by, method, v, c times) weighing the method's share
    in the group's pool, all rows that agree in `pool`, over its share in the group."""
    own = frame.groupBy(*by, "method").agg(F.sum("c").alias("c")).withColumn("own", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))
    ref = own.groupBy(*pool, "method").agg(F.sum("c").alias("c")).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(*pool))).drop("c")
    weight = own.join(ref, [*pool, "method"]).select(*by, "method", (F.col("share") / F.col("own")).alias("weight"))
    at = frame.join(weight, [*by, "method"]).groupBy(*by, "v").agg(F.sum(F.col("c") * F.col("weight")).alias("w"))
    mean = at.groupBy(*by).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))
    ranks = x.first_reaching(at, by, "w", {name: (lambda total, q=q: total * F.lit(q) * F.lit(1 - 1e-12)) for name, q in Q3.items()})
    return mean.join(ranks, by)


# ---- coverage --------------------------------------------------------------------------------------------------------


def headline(calls: DataFrame) -> DataFrame:
    span = F.col("last") - F.col("first")
    out = calls.agg(F.min("ts_start").alias("first"), F.max("ts_start").alias("last"), F.countDistinct("flow_id").alias("flows"), F.count("*").alias("calls"))
    rate = lambda c: F.when(span != 0, F.try_divide(F.col(c), span))
    return out.select("first", "last", span.alias("span_seconds"), "flows", "calls", rate("flows").alias("req_per_s"), rate("calls").alias("calls_per_s"))


def batch_distribution(calls: DataFrame) -> DataFrame:
    per = flows(calls, "batch_size")
    return per.groupBy(x.size_bucket(F.col("batch_size")).alias("bucket")).agg(F.count("*").alias("flows"), F.sum("batch_size").alias("calls"))


def top_methods(calls: DataFrame, n: int = 15) -> DataFrame:
    return calls.groupBy("method").agg(F.count("*").alias("calls"), F.countDistinct("flow_id").alias("flows")).orderBy(F.desc("calls"), "method").limit(n)


def error_codes(calls: DataFrame, n: int = 10) -> DataFrame:
    return calls.where("error_code is not null").groupBy("error_code").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "error_code").limit(n)


def namespace_coverage(calls: DataFrame) -> DataFrame:
    by_method = calls.groupBy("method").agg(F.count("*").alias("c"))
    return by_method.groupBy(x.namespace(F.col("method")).alias("namespace")).agg(F.count("*").alias("methods"), F.sum("c").alias("calls"))


def namespace_bytes(calls: DataFrame) -> DataFrame:
    per = flows(calls, "method", "flow_resp_bytes")
    return per.groupBy(x.namespace(F.col("method")).alias("namespace")).agg(F.sum("flow_resp_bytes").alias("bytes"))


def distinct_methods(calls: DataFrame) -> DataFrame:
    return calls.agg(F.countDistinct("method").alias("methods"))


def node_identity(calls: DataFrame, lotus_version: str | None = None) -> DataFrame:
    """Agent, version, commit, date and label of the node from its latest version calls; lotus_version stands for the version published."""
    answered = calls.where("method in ('Filecoin.Version', 'web3_clientVersion') and result_json is not null")
    last = answered.agg(F.max_by(F.struct("method", "result_json"), F.struct("ts_start", "flow_id", "position")).alias("l"), F.max_by(F.when(F.col("method") == "Filecoin.Version", F.col("result_json")), F.when(F.col("method") == "Filecoin.Version", F.struct("ts_start", "flow_id", "position"))).alias("fc"))
    start = calls.agg(F.min("ts_start").alias("t"))
    one = last.join(F.broadcast(start), F.lit(True), "left")  # one row each
    text = F.coalesce(F.from_json(F.concat(F.lit('{"s":'), F.col("l.result_json"), F.lit("}")), "s string")["s"], F.col("l.result_json"))
    is_fc = F.col("l.method") == "Filecoin.Version"
    slash = F.instr(text, "/") > 0
    agent = F.coalesce(F.get_json_object("fc", "$.Agent"), F.when(is_fc, F.get_json_object("l.result_json", "$.Agent")).when(slash, F.substring_index(text, "/", 1)))
    raw = F.coalesce(F.when(is_fc, F.get_json_object("l.result_json", "$.Version")).when(slash, F.expr("null")).otherwise(text), F.when(~is_fc & slash, F.regexp_extract(text, "(?s)^[^/]*/(.*)$", 1)))
    one = one.select(agent.alias("a"), F.when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(raw).alias("v"), "t")
    commit = F.when(F.instr("v", "+git.") > 0, F.split(F.regexp_extract("v", r"(?s)\+git\.(.*)$", 1), r"\+")[0]).otherwise("")
    short = F.split("v", r"\+")[0]
    version = F.when(short.rlike("^[0-9]"), F.concat(F.lit("v"), short)).otherwise(short)
    name = F.coalesce(F.when(F.col("a") == "", None).otherwise(F.col("a")), F.lit("node"))
    shown = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000)))
    date = F.coalesce(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"), F.lit("unknown"))
    one = one.select(shown.alias("agent"), version.alias("version"), commit.alias("commit"), date.alias("capture_date"), F.lower(name).alias("slug"))
    label = F.when(F.col("slug") == "forest", F.concat(F.lit("Forest: "), "capture_date", F.when(F.col("commit") != "", F.concat(F.lit("-"), F.substring("commit", 1, 7))).otherwise("")))
    label = label.when(F.col("slug") == "lotus", F.concat(F.lit("Lotus: "), F.coalesce(F.lit(lotus_version).cast("string"), F.col("version")))).otherwise(F.concat("agent", F.lit(": "), "version"))
    return one.select("agent", "version", "commit", "capture_date", label.alias("label"))


# ---- the summary report ----------------------------------------------------------------------------------------------


def capture_window(calls: DataFrame) -> DataFrame:
    ts = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    s = F.floor(F.col("last") - F.col("first")).cast("long")
    text = F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return calls.agg(F.min("ts_start").alias("first"), F.max("ts_start").alias("last")).select(ts("first").alias("first_utc"), ts("last").alias("last_utc"), text.alias("span"))


def summary_counts(calls: DataFrame) -> DataFrame:
    """Rows, flows, flows without a response, replied flows; and calls with a result, with an error, with neither, in one pass."""
    lost = F.countDistinct(F.when(F.col("http_status").isNull(), F.col("flow_id")))
    out = calls.agg(F.count("*").alias("rows"), F.countDistinct("flow_id").alias("flows"), lost.alias("no_response"), F.count("result_json").alias("success"), F.count("error_code").alias("errors"))
    return out.select("*", (F.col("flows") - F.col("no_response")).alias("replied"), (F.col("rows") - F.col("success") - F.col("errors")).alias("no_answer"))


def bucket_table(calls: DataFrame) -> DataFrame:
    """All five buckets in order, with zeros."""
    names = ["1", *(n for n, _ in x.BUCKETS)]
    every = calls.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "bucket_ord int, bucket string")
    counts = batch_distribution(calls)
    return every.join(counts, "bucket", "left").select("bucket_ord", "bucket", F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("calls", F.lit(0)).alias("calls"))


def flow_latency(calls: DataFrame) -> DataFrame:
    per = flows(calls, "duration_ms")
    return x.with_quantiles(per, [], "duration_ms", "nearest", Q3, {"avg": "mean", "max": "max"})


def call_latency(calls: DataFrame) -> DataFrame:
    each = calls.select((F.col("duration_ms") / F.col("batch_size")).alias("v"))
    return x.with_quantiles(each, [], "v", "nearest", Q3, {"avg": "mean", "max": "max"})


def body_sizes(calls: DataFrame) -> DataFrame:
    per = flows(calls, "flow_req_bytes", "flow_resp_bytes")
    long = per.select(F.explode(F.array(F.struct(F.lit("request").alias("side"), F.col("flow_req_bytes").alias("v")), F.struct(F.lit("response").alias("side"), F.col("flow_resp_bytes").alias("v")))).alias("s")).select("s.*")
    return x.with_quantiles(long, ["side"], "v", "nearest", {"p50": 0.5, "p95": 0.95}, {"max": "max"}).withColumn("max", F.col("max").cast("long"))


def status_distribution(calls: DataFrame) -> DataFrame:
    return flows(calls, "http_status").groupBy("http_status").agg(F.count("*").alias("flows"))


# ---- task tables -----------------------------------------------------------------------------------------------------


def latency_by_method(calls: DataFrame, n: int = 30, rule: str = "nearest") -> DataFrame:
    out = x.with_quantiles(singles(calls), ["method"], "duration_ms", rule, Q3, {"n": "rows", "avg": "mean", "max": "max"})
    return out.orderBy(F.desc("n"), "method").limit(n)


def batch_latency_by_bucket(calls: DataFrame) -> DataFrame:
    return summarise_buckets(batch_flows(calls), "duration_ms", "nearest", more={"max": "max"})


def batch_latency_by_method(calls: DataFrame, n: int = 30) -> DataFrame:
    """Flows that hold a method, with the flow's latency."""
    per = calls.where("batch_size > 1").groupBy("flow_id", "method").agg(F.max("batch_size").alias("batch_size"), F.max("duration_ms").alias("duration_ms"))
    out = x.with_quantiles(per, ["method"], "duration_ms", "nearest", Q3, {"flows": "rows", "avg": "mean"})
    sizes = x.with_quantiles(per, ["method"], "batch_size", "linear", {"median_batch": 0.5}, {})
    return out.orderBy(F.desc("flows"), "method").limit(n).join(sizes, "method", "left")


def errors_by_method(calls: DataFrame, n: int = 30) -> DataFrame:
    """The methods called most, also those without an error, with their error rate to two digits; equal counts by method."""
    out = calls.groupBy("method").agg(F.count("*").alias("calls"), F.count("error_code").alias("errors"))
    return out.withColumn("err_pct", F.round(F.col("errors") / F.col("calls") * 100, 2)).orderBy(F.desc("calls"), "method").limit(n)


def slow_flows(calls: DataFrame, method: str | None = None, n: int = 15, params_cap: int = 200, error_cap: int = 80) -> DataFrame:
    kept = calls.where(F.col("method") == method) if method else calls
    first = Window.partitionBy("flow_id").orderBy(F.col("duration_ms").desc_nulls_last(), "position")
    top = kept.withColumn("k", F.row_number().over(first)).where("k = 1").orderBy(F.col("duration_ms").desc_nulls_last(), "flow_id").limit(n)
    return top.select("flow_id", "duration_ms", "batch_size", "method", "error_code", x.clipped(F.col("error_message"), error_cap).alias("error_message"), x.clipped(F.col("params_json"), params_cap).alias("params_json"))


def popular_params(calls: DataFrame, method: str | None = None, methods: int = 15, params: int = 5) -> DataFrame:
    """The methods called most with their commonest parameters, from one aggregation; null parameters are a group."""
    kept = calls.where(F.col("method") == method) if method else calls
    pairs = kept.groupBy("method", "params_json").agg(F.count("*").alias("count"))
    totals = pairs.groupBy("method").agg(F.sum("count").alias("total"), F.count("*").alias("distinct_params")).orderBy(F.desc("total"), "method").limit(methods)
    rank = Window.partitionBy("method").orderBy(F.desc("count"), F.col("params_json").asc_nulls_first())
    ranked = pairs.join(F.broadcast(totals), "method").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= params)  # totals has at most `methods` rows
    return ranked.select("method", "total", "distinct_params", "rank", "count", x.params_label(F.col("params_json")).alias("params"))


def peek(calls: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, by flow and position."""
    return calls.orderBy("flow_id", "position").limit(n)


def schema_of(calls: DataFrame) -> DataFrame:
    """Columns in order with their types."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(calls.schema)]
    return calls.sparkSession.createDataFrame(rows, "ordinal int, column string, type string")


# ---- before and after ------------------------------------------------------------------------------------------------


def tagged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def _sides(df: DataFrame, *keys: str) -> DataFrame:
    """Rows (side, keys, ...) to one row a key with each column of either side, null where the side has none."""
    rest = [c for c in df.columns if c not in ("side", *keys)]
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in "ab" for c in rest))


def compare_methods(a: DataFrame, b: DataFrame, n: int = 30, sort: str = "n", exclude: list[str] | None = None, rule: str = "nearest") -> DataFrame:
    """Single calls by method, before and after, with deltas; ranked by the larger count or the largest change."""
    both = _sides(x.with_quantiles(singles(without(tagged(a, b), exclude)), ["side", "method"], "duration_ms", rule, Q3, {"n": "rows", "mean": "mean"}), "method")
    for m in ("mean", *Q3):
        both = both.withColumn(f"d_{m}", F.col(f"{m}_b") - F.col(f"{m}_a")).withColumn(f"d_{m}_pct", x.pct_change(F.col(f"{m}_a"), F.col(f"{m}_b")))
    rank = F.abs(f"d_{sort}") if sort in ("mean", *Q3) else F.greatest("n_a", "n_b")
    both = both.withColumn("rank_key", rank).orderBy(F.col("rank_key").desc_nulls_last(), "method").limit(n)
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b")})


def _metrics(sides: DataFrame, *keys: str, names: tuple[str, ...] = ("avg", *Q3)) -> DataFrame:
    found = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("before"), F.col(f"{m}_b").alias("after")) for m in names)))
    return sides.select(*keys, found.alias("m")).select(*keys, "m.*")


def compare_overall(a: DataFrame, b: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Flows and calls, before and after, by the lower rule; change 0 from a base of 0."""
    sides = _sides(overall_latency(without(tagged(a, b), exclude), "lower", ("flow", "call")), "view")
    return _metrics(sides, "view").withColumn("delta", F.col("after") - F.col("before")).withColumn("delta_pct", x.pct_change_or_zero(F.col("before"), F.col("after")))


def compare_reweighted(a: DataFrame, b: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Both sides under their pooled method mix, for flows and calls. All follows from one count by view, side, method and value. A side
    without rows gives NaN."""
    frame = viewed(without(tagged(a, b), exclude)).groupBy("view", "side", "method", "v").agg(F.sum("c").alias("c"))
    out = reweighted(frame, ["view", "side"], ["view"])
    every = a.sparkSession.createDataFrame([(v, s) for v in ("flow", "call") for s in "ab"], "view string, side string")
    told = every.join(out, ["view", "side"], "left")
    nan = F.lit(float("nan"))
    return told.select("view", F.when(F.col("side") == "a", "before").otherwise("after").alias("side"), *(F.coalesce(c, nan).alias(c) for c in ("mean", *Q3)))


def compare_batches(a: DataFrame, b: DataFrame, exclude: list[str] | None = None, rule: str = "nearest") -> DataFrame:
    """Buckets of batches before and after, for wall time and cost of a call."""
    per = batch_flows(tagged(a, b), exclude)
    views = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("v")) for v in ("duration_ms", "per_call_ms"))))
    long = per.select("side", "bucket", views.alias("x")).select("side", "bucket", "x.*")
    both = _sides(summarise_buckets(long, "v", rule, ("side", "view", "bucket")), "view", "bucket")
    for m in ("mean", "p50", "p95"):
        both = both.withColumn(f"d_{m}_pct", x.pct_change(F.col(f"{m}_a"), F.col(f"{m}_b")))
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("flows_a", "flows_b")}).withColumn("bucket_ord", x.bucket_order(F.col("bucket")).cast("int"))
