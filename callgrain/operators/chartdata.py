"""The tables behind the charts; drawing is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import exprs as x
from . import traffic as t


def per_flow(calls: DataFrame) -> DataFrame:
    return t.flows(calls, "duration_ms", "ts_start", "batch_size").where("duration_ms is not null")


def date_label(calls: DataFrame) -> DataFrame:
    """First and last day, start and span in hours."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "MMM d, yyyy")
    return calls.agg(F.min("ts_start").alias("t0"), F.max("ts_start").alias("t1")).select(day("t0").alias("first_day"), day("t1").alias("last_day"), "t0", ((F.col("t1") - F.col("t0")) / 3600).alias("hours"))


def reliability(calls: DataFrame) -> DataFrame:
    """Calls, answers, bytes of distinct flows, rate, flow latency and methods on one row."""
    whole = calls.agg(F.count("*").alias("calls"), F.count_if(F.col("result_json").isNull() & F.col("error_code").isNull()).alias("no_answer"), F.countDistinct("method").alias("methods"), (F.max("ts_start") - F.min("ts_start")).alias("span"))
    per = t.flows(calls, "flow_resp_bytes", "duration_ms")
    ranks = x.with_quantiles(per, [], "duration_ms", "linear", {"p50": 0.5, "p95": 0.95}, {})
    one = whole.join(F.broadcast(per.agg(F.sum("flow_resp_bytes").alias("bytes"))), F.lit(True), "left").join(F.broadcast(ranks), F.lit(True), "left")  # one row each
    return one.select("calls", "no_answer", (F.col("calls") - F.col("no_answer")).alias("answered"), (F.try_divide(F.col("calls") - F.col("no_answer"), "calls") * 100).alias("answered_pct"), "bytes", F.try_divide("calls", "span").alias("calls_per_s"), "p50", "p95", "methods")


def batching(calls: DataFrame, baseline: str = "eth_call") -> DataFrame:
    """Calls, share and cost of a call by bucket, and how many times cheaper than the baseline method alone."""
    dist = t.bucket_table(calls).withColumn("share_pct", F.try_divide("calls", F.sum("calls").over(Window.partitionBy())) * 100)  # five rows
    cost = t.batch_flows(calls).groupBy("bucket").agg(F.avg("per_call_ms").alias("cost"))
    alone = calls.where((F.col("batch_size") == 1) & (F.col("method") == baseline)).agg(F.avg("duration_ms").alias("alone"))
    out = dist.join(cost, "bucket", "left").join(F.broadcast(alone), F.lit(True), "left")
    out = out.withColumn("cost", F.when(F.col("bucket") == "1", F.col("alone")).otherwise(F.col("cost")))
    return out.select("bucket_ord", "bucket", "flows", "calls", "share_pct", "cost", F.try_divide("alone", "cost").alias("times_cheaper"))


def mix(calls: DataFrame) -> DataFrame:
    known = t.namespace_coverage(calls).where("namespace <> 'other'")
    return known.withColumn("share_pct", F.col("calls") / F.sum("calls").over(Window.partitionBy()) * 100)  # six rows at most


def method_pairs(a: DataFrame, b: DataFrame, n: int = 30) -> DataFrame:
    """Methods with a mean on both sides, the n with the larger count on either."""
    both = t._sides(t.singleton_per_method(t.tagged(a, b)), "method").where("mean_a is not null and mean_b is not null")
    return both.withColumn("most", F.greatest("n_a", "n_b")).orderBy(F.desc("most"), "method").limit(n)


def batch_dumbbells(a: DataFrame, b: DataFrame, value: str = "duration_ms") -> DataFrame:
    """A row for each bucket on both sides and metric: before, after, delta, its label, the label's place (the geometric mean), and the rows'
    label; overall is the verdict of the median of all deltas."""
    per = t.summarise_buckets(t.batch_flows(t.tagged(a, b)), value, by=("side", "bucket")).withColumnRenamed("mean", "avg")
    both = t._sides(per, "bucket").where("flows_a is not null and flows_b is not null")
    long = t._metrics(both, "bucket", "flows_a", "flows_b", names=("avg", "p50", "p95")).where("before is not null and after is not null")
    verdict = x.verdict_lower_better(x.pct_change_or_zero(F.col("before"), F.col("after")))
    long = long.withColumn("delta", F.col("after") - F.col("before")).withColumn("label_x", F.sqrt(F.col("before") * F.col("after"))).withColumn("verdict", verdict)
    long = long.withColumn("label", x.delta_label(F.col("before"), F.col("after"), F.col("verdict") == "same"))
    long = long.withColumn("bucket_label", F.concat(F.lit("("), x.human_calls(F.col("flows_a")), F.lit("→"), x.human_calls(F.col("flows_b")), F.lit(" flows)  "), "bucket"))
    overall = long.agg(F.median("delta").alias("median_delta"))  # of a dozen rows at most
    return long.join(F.broadcast(overall), F.lit(True), "left").withColumn("overall", F.when(F.col("median_delta") < 0, "better").when(F.col("median_delta") > 0, "worse").otherwise("same"))


def overall_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overall latency before and after by view and metric, with each view's verdict from the median of its changes."""
    long = t._metrics(t._sides(t.overall_latency(t.tagged(a, b)), "view"), "view")
    long = long.withColumn("delta", F.col("after") - F.col("before")).withColumn("delta_pct", x.pct_change_or_zero(F.col("before"), F.col("after")))
    medians = long.groupBy("view").agg(F.median("delta_pct").alias("median_pct"))  # of four rows
    return long.join(medians, "view").withColumn("verdict", F.when(F.col("median_pct") < 0, "better").when(F.col("median_pct") > 0, "worse").otherwise("same"))


# 80 even points of the curve from 0.01 to 0.98 and 20 of its tail from 0.981 to 0.999; the marked ones.
CDF_POINTS = [round(0.01 + i * (0.98 - 0.01) / 79, 12) for i in range(80)] + [round(0.981 + i * (0.999 - 0.981) / 19, 12) for i in range(20)]
CDF_MARKS = {"median": 0.5, "p95": 0.95}


def _curve(a: DataFrame, b: DataFrame, points: list[float]) -> DataFrame:
    per = per_flow(t.tagged(a, b))
    wide = x.with_quantiles(per, ["side"], "duration_ms", "linear", {f"q{i}": q for i, q in enumerate(points)}, {})
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("duration_ms")) for i, q in enumerate(points))))
    return wide.select(F.when(F.col("side") == "a", "before").otherwise("after").alias("phase"), each.alias("e")).select("phase", "e.*")


def cdf(a: DataFrame, b: DataFrame, points: list[float] | None = None) -> DataFrame:
    """(phase, q, duration_ms) at 100 quantiles of both sides' flow latency."""
    return _curve(a, b, points or CDF_POINTS)


def cdf_marks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The marked points of the curve with their labels."""
    names = F.create_map(*(F.lit(v) for name, q in CDF_MARKS.items() for v in (q, name)))
    return _curve(a, b, list(CDF_MARKS.values())).withColumn("label", F.concat(names[F.col("q")], F.lit(" "), x.ms_label(F.col("duration_ms"))))


def scorecard(a: DataFrame, b: DataFrame, n: int = 10, few: int = 100) -> DataFrame:
    """Top methods of b with a mean in a; changes clipped to 50 %, baselines of fewer than `few` calls flagged."""
    sides = t._sides(t.singleton_per_method(t.tagged(a, b)).select("side", "method", "n", "mean", "p95"), "method")
    both = sides.where("n_b is not null").orderBy(F.desc("n_b"), "method").limit(n).where("mean_a is not null")
    out = both.withColumn("low", F.col("n_a") < few)
    for m in ("mean", "p95"):
        d = x.pct_change_or_zero(F.col(f"{m}_a"), F.col(f"{m}_b"))
        out = out.withColumn(f"{m}_chg", F.when(F.col("low"), 0.0).otherwise(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), d)))).withColumn(f"{m}_same", ~F.col("low") & (F.abs(d) < 3))
    return out


def bandwidth(calls: DataFrame, n: int = 8) -> DataFrame:
    """Response bytes of single calls by method, and of all flows."""
    total = t.flows(calls, "flow_resp_bytes").agg(F.sum("flow_resp_bytes").alias("total_bytes"))
    by_method = t.singles(calls).groupBy("method").agg(F.sum("flow_resp_bytes").alias("bytes")).orderBy(F.desc("bytes"), "method").limit(n)
    return by_method.join(F.broadcast(total), F.lit(True), "left").withColumn("label", x.bytes_label(F.col("bytes")))


def load_latency(calls: DataFrame, seconds: int = 600) -> DataFrame:
    """Bins from the first flow on: calls a second and p95, with the regression line of one on the other."""
    per = per_flow(calls)
    start = per.agg(F.min("ts_start").alias("t0"))
    placed = per.join(F.broadcast(start), F.lit(True), "left").withColumn("bin", F.floor((F.col("ts_start") - F.col("t0")) / seconds))  # one row
    ranks = x.with_quantiles(placed, ["bin"], "duration_ms", "linear", {"p95": 0.95}, {})
    bins = placed.groupBy("bin").agg((F.sum("batch_size") / seconds).alias("calls_s")).join(ranks, "bin")
    line = bins.agg(F.regr_slope("p95", "calls_s").alias("slope"), F.regr_intercept("p95", "calls_s").alias("intercept"))
    return bins.join(F.broadcast(line), F.lit(True), "left")


def error_kinds(calls: DataFrame) -> DataFrame:
    """Calls by outcome; outcomes without a call are absent."""
    failed = F.col("error_code").isNotNull()
    revert = failed & (F.col("method").isin(*x.REVERTING) | F.coalesce(F.col("error_message").rlike(x.REVERT_TEXT), F.lit(False)))
    one = calls.agg(F.count("*").alias("total"), F.count("result_json").alias("success"), F.count_if(failed).alias("errors"), F.count_if(revert).alias("revert"))
    kinds = F.array(
        F.struct(F.lit("result").alias("kind"), F.col("success").alias("calls")),
        F.struct(F.lit("revert").alias("kind"), F.col("revert").alias("calls")),
        F.struct(F.lit("error").alias("kind"), (F.col("errors") - F.col("revert")).alias("calls")),
        F.struct(F.lit("no answer").alias("kind"), F.greatest(F.lit(0), F.col("total") - F.col("success") - F.col("errors")).alias("calls")),
    )
    return one.select("total", F.explode(kinds).alias("k")).select("k.*", "total").where("calls > 0").withColumn("pct", F.col("calls") / F.col("total") * 100).drop("total")


def charts(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """The tables of all charts of a comparison, by name; a is before, b after."""
    return {
        "overall": overall_pairs(a, b), "per_method": method_pairs(a, b), "batch_wall_time": batch_dumbbells(a, b), "batch_cost_per_call": batch_dumbbells(a, b, "per_call_ms"), "scorecard": scorecard(a, b),
        "cdf": cdf(a, b), "cdf_marks": cdf_marks(a, b), "reliability": reliability(b), "batching": batching(b), "mix": mix(b), "bandwidth": bandwidth(b), "load_latency": load_latency(b), "error_kinds": error_kinds(b),
    }
