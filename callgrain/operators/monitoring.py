"""Server series by clock time: (window, metric, mode, t, v) in long form to usage, utilisation, load and bandwidth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import exprs as x

GIB = float(1 << 30)
ORDER = ("may22", "may26", "now24h")


def series(points: DataFrame, metric: str, name: str) -> DataFrame:
    """The metric's first series, one value a second: the last given wins."""
    held = points.where(F.col("metric") == metric)
    return held.groupBy("window", "t").agg(F.max_by("v", "ordinal").alias(name))


def used(points: DataFrame, whole: str, free: str) -> DataFrame:
    """GiB in use at the seconds that both series have."""
    return series(points, whole, "a").join(series(points, free, "b"), ["window", "t"]).select("window", "t", ((F.col("a") - F.col("b")) / GIB).alias("gib"))


def window_order(name):
    listed = F.array(*map(F.lit, ORDER))
    at = F.array_position(listed, name)
    return F.when(at > 0, at).otherwise(99)


def mem_series(points: DataFrame) -> DataFrame:
    return used(points, "memory_total", "memory_available")


def disk_series(points: DataFrame) -> DataFrame:
    return used(points, "filesystem_size", "filesystem_free")


def cpu_steps(points: DataFrame) -> DataFrame:
    """Consecutive seconds that all modes have: utilisation and cores of each step; steps with a falling counter or no time are left out."""
    cpu = points.where(F.col("metric") == "cpu").groupBy("window", "t", "mode").agg(F.max_by("v", "ordinal").alias("v"))
    modes = cpu.select("window", "mode").distinct().groupBy("window").agg(F.count("*").alias("all"))
    full = cpu.groupBy("window", "t").agg(F.count("*").alias("k")).join(modes, "window").where("k = all").select("window", "t")
    by = Window.partitionBy("window", "mode").orderBy("t")
    steps = cpu.join(full, ["window", "t"]).select("window", "mode", F.lag("t").over(by).alias("a"), F.col("t").alias("b"), (F.col("v") - F.lag("v").over(by)).alias("d")).where("a is not null")
    each = steps.groupBy("window", "a", "b").agg(F.sum("d").alias("total"), F.min("d").alias("least"), F.coalesce(F.sum(F.when(F.col("mode") == "idle", F.col("d"))), F.lit(0.0)).alias("idle"))
    good = each.where("total > 0 and b > a and least >= 0")
    return good.select("window", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("t"), (100 * (1 - F.col("idle") / F.col("total"))).alias("util"), (F.col("total") / (F.col("b") - F.col("a"))).alias("cores"))


def mem_stats(points: DataFrame) -> DataFrame:
    whole = series(points, "memory_total", "v").groupBy("window").agg((F.avg("v") / GIB).alias("total"))
    u = x.with_quantiles(mem_series(points), ["window"], "gib", "half_even", {"used_p95": 0.95}, {"used_min": "min", "used_mean": "mean", "used_max": "max", "n": "rows"})
    return u.join(whole, "window").withColumn("pct_mean", 100 * F.col("used_mean") / F.col("total")).withColumn("pct_max", 100 * F.col("used_max") / F.col("total"))


def cpu_stats(points: DataFrame) -> DataFrame:
    steps = cpu_steps(points)
    cores = steps.groupBy("window").agg(F.bround(F.avg("cores")).cast("long").alias("cores"))
    return x.with_quantiles(steps, ["window"], "util", "half_even", {"util_p95": 0.95}, {"util_mean": "mean", "util_max": "max", "n": "rows"}).join(cores, "window")


def disk_stats(points: DataFrame) -> DataFrame:
    whole = series(points, "filesystem_size", "v").groupBy("window").agg((F.avg("v") / GIB).alias("size"))
    u = disk_series(points).groupBy("window").agg(F.avg("gib").alias("used_mean"), F.max("gib").alias("used_max"))
    return u.join(whole, "window").withColumn("pct_mean", 100 * F.col("used_mean") / F.col("size")).withColumn("pct_max", 100 * F.col("used_max") / F.col("size"))


def load_stats(points: DataFrame) -> DataFrame:
    return x.with_quantiles(series(points, "load_1", "v"), ["window"], "v", "half_even", {"p95": 0.95}, {"mean": "mean", "max": "max"})


def bw_stats(points: DataFrame) -> DataFrame:
    out = None
    for d in ("inbound", "outbound"):
        one = series(points, f"bw_{d}", "v").groupBy("window").agg(F.avg("v").alias("mean"), F.max("v").alias("max")).withColumn("direction", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return out


def do_summary(points: DataFrame) -> DataFrame:
    """One row a window."""
    m = mem_stats(points).select("window", F.col("used_mean").alias("mem_mean"), F.col("used_max").alias("mem_max"), F.col("total").alias("mem_total"))
    c = cpu_stats(points).select("window", "util_mean", "util_p95", "cores")
    d = disk_stats(points).select("window", F.col("used_mean").alias("disk_mean"), F.col("used_max").alias("disk_max"))
    out = m.join(c, "window", "full").join(d, "window", "full")
    return out.withColumn("window_ord", window_order(F.col("window")).cast("int"))


def overlay(one: DataFrame, value: str, starts: DataFrame) -> DataFrame:
    """A series in hours since each window's start; starts is (window, t0)."""
    return one.join(starts, "window").select("window", ((F.col("t") - F.col("t0")) / 3600).alias("hour"), value)


def window_for(points: DataFrame, captures: DataFrame) -> DataFrame:
    """For each capture (capture, t0, t1) the window whose memory samples overlap it longest; equal overlaps by name, none without overlap.
    Windows and captures are file lists, a handful each, so their pairs are too."""
    spans = points.where("metric = 'memory_total'").groupBy("window").agg(F.min("t").alias("w0"), F.max("t").alias("w1"))
    pairs = captures.join(F.broadcast(spans), (F.col("w0") < F.col("t1")) & (F.col("w1") > F.col("t0")))
    ov = F.least("t1", "w1") - F.greatest("t0", "w0")
    best = Window.partitionBy("capture").orderBy(F.desc("overlap"), "window")
    return pairs.withColumn("overlap", ov.cast("double")).withColumn("k", F.row_number().over(best)).where("k = 1").select("capture", "window", "overlap")


def load_compare(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Two runs (side before/after, window, t0, t1) clipped to the shorter: mean CPU and memory, and the gaps in cores and GB."""
    span = runs.agg(F.min(F.col("t1") - F.col("t0")).alias("span"))
    clip = runs.join(F.broadcast(span), F.lit(True), "left").select("side", "window", "t0", (F.col("t0") + F.col("span")).alias("end"))
    cpu = cpu_steps(points).join(clip, "window").where("t between t0 and end").groupBy("side").agg(F.avg("util").alias("cpu"))
    mem = mem_series(points).join(clip, "window").where("t between t0 and end").groupBy("side").agg(F.avg("gib").alias("mem"))
    cores = cpu_stats(points).join(runs.where("side = 'before'").select("window"), "window").agg(F.first("cores").alias("cores"))
    side = cpu.join(mem, "side", "full").groupBy(F.lit(1).alias("one")).agg(*(F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{m}_{s}") for s in ("before", "after") for m in ("cpu", "mem"))).drop("one")
    both = side.join(F.broadcast(cores), F.lit(True), "left")
    return both.withColumn("cores_delta", (F.col("cpu_after") - F.col("cpu_before")) / 100 * F.col("cores")).withColumn("mem_delta", F.col("mem_after") - F.col("mem_before"))


def load_frames(points: DataFrame, runs: DataFrame) -> DataFrame:
    """The curves behind load_compare: (side, metric cpu or mem, hour since the run's start, value), over the shorter run's hours."""
    span = runs.agg(F.min(F.col("t1") - F.col("t0")).alias("span"))
    clip = runs.join(F.broadcast(span), F.lit(True), "left").select("side", "window", "t0", "span")  # a row a run
    both = cpu_steps(points).select("window", "t", F.lit("cpu").alias("metric"), F.col("util").alias("value")).unionByName(mem_series(points).select("window", "t", F.lit("mem").alias("metric"), F.col("gib").alias("value")))
    hour = (F.col("t") - F.col("t0")) / 3600
    return both.join(clip, "window").withColumn("hour", hour).where(F.col("hour").between(0, F.col("span") / 3600)).select("side", "metric", "hour", "value")


def coverage(points: DataFrame, captures: DataFrame, least: float = 0.9) -> DataFrame:
    """The share of each capture (capture, window, t0, t1) that its window's samples span; short ones are flagged."""
    t = points.where("metric = 'memory_total'").select("window", "t").distinct()
    inside = captures.join(t, "window").where("t between t0 and t1").groupBy("capture").agg((F.max("t") - F.min("t")).alias("covered"))
    out = captures.join(inside, "capture", "left").withColumn("share", F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), F.col("t1") - F.col("t0")))
    return out.select("capture", "window", "share", (F.col("share") < least).alias("short"))


def samples(points: DataFrame) -> DataFrame:
    return points.groupBy("window", "metric").agg(F.count("*").alias("samples"))
