"""Column expressions: batch buckets, namespaces, formats, changes; and the quantile rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bucket names with their upper bounds, and method prefixes by namespace.
BUCKETS = (("2-10", 10), ("11-50", 50), ("51-99", 99), ("100+", None))
REPLAY_BUCKETS = (("1", 1), ("2-10", 10), ("11-50", 50), ("51-100", 100), ("100+", None))
NAMESPACES = (("Filecoin", "Filecoin."), ("eth", "eth_"), ("trace", "trace_"), ("F3", "F3."), ("net", "net_"), ("web3", "web3_"))
REVERTING = ("eth_call", "eth_estimateGas", "eth_createAccessList")
REVERT_TEXT = "execution failed|failed to apply|revert"


def _stepped(value: Column, steps) -> Column:
    out = None
    for name, top in steps:
        if top is None:
            return out.otherwise(F.lit(name))
        out = (F if out is None else out).when(value <= top, F.lit(name))
    return out


def batch_bucket(size: Column) -> Column:
    """Bucket of a batch of more than one call."""
    return _stepped(size, BUCKETS)


def size_bucket(size: Column) -> Column:
    """The same with single calls as '1'."""
    return _stepped(size, (("1", 1), *BUCKETS))


def replay_bucket(size: Column) -> Column:
    """The buckets of the replay report, where 100 isn't in the last."""
    return _stepped(size, REPLAY_BUCKETS)


def bucket_order(bucket: Column) -> Column:
    names = ["1", *(n for n, _ in BUCKETS)]
    return F.array_position(F.array(*map(F.lit, names)), bucket)


def namespace(method: Column) -> Column:
    out = None
    for name, prefix in NAMESPACES:
        out = (F if out is None else out).when(method.startswith(prefix), F.lit(name))
    return out.otherwise(F.lit("other"))


def pct_change(before: Column, after: Column) -> Column:
    """Percent; null where a side is missing, and where before is 0."""
    return F.try_divide(after - before, before) * 100


def pct_change_or_zero(before: Column, after: Column) -> Column:
    return F.when(before.isNull() | after.isNull(), None).when(before == 0, 0.0).otherwise(F.try_divide(after - before, before) * 100)


def verdict_lower_better(change: Column, flat: float = 3.0) -> Column:
    return F.when(F.abs(change) < flat, "same").when(change < 0, "better").otherwise("worse")


def verdict_higher_better(change: Column, flat: float = 3.0) -> Column:
    return F.when(F.abs(change) < flat, "same").when(change > 0, "better").otherwise("worse")


def verdict_vs_load(change: Column, load: Column, flat: float = 3.0) -> Column:
    """A cost that grows with load: good if it grew at most half as much, fair if less than it."""
    return F.when(change <= flat, "better").when((load > 0) & (change <= 0.5 * load), "better").when((load > 0) & (change <= load), "close").otherwise("worse")


def _fixed(v: Column, digits: int) -> Column:
    """With so many digits, rounded by the value that the double has, exact halves to even: format_string rounds its shortest decimal up.
    Where v times ten to the digits ends in a half, the product's error (by splitting v in two) tells on which side v is."""
    ten = F.lit(float(10**digits))
    p = v * ten
    low, c = F.floor(p).cast("double"), v * 134217729.0
    high = c - (c - v)
    error = (high * ten - p) + (v - high) * ten
    up = (p - low > 0.5) | ((p - low == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    return F.format_string(f"%.{digits}f", (low + F.when(up, 1.0).otherwise(0.0)) / ten)


def _thousands(v: Column, least_short: float | None) -> Column:
    """k and M; of a number from least_short units on no digit is shown."""
    def unit(name: str, size: float) -> Column:
        x = v / size
        long = F.concat(_fixed(x, 1), F.lit(name))
        return long if least_short is None else F.when(x < least_short, long).otherwise(F.concat(_fixed(x, 0), F.lit(name)))

    return F.when(F.abs(v) >= 1e6, unit("M", 1e6)).when(F.abs(v) >= 1e3, unit("k", 1e3)).otherwise(_fixed(v, 0))


def human(value: Column) -> Column:
    """1234 as 1.2k, 123400 as 123k, 1.2M."""
    return _thousands(value.cast("double"), 100.0)


def human_calls(value: Column) -> Column:
    """The same for counts of calls, with one digit throughout: 95438 as 95.4k."""
    return _thousands(value.cast("double"), None)


def ms_label(value: Column) -> Column:
    v = value.cast("double")
    return F.when(v < 10, F.concat(_fixed(v, 1), F.lit(" ms"))).otherwise(F.concat(_fixed(v, 0), F.lit(" ms")))


def delta_label(before: Column, after: Column, tie: Column) -> Column:
    """The gap in units of time, never in percent."""
    gap = F.abs(after - before)
    text = F.when(gap >= 1000, F.concat(_fixed(gap / 1000, 2), F.lit(" s"))).otherwise(F.concat(_fixed(gap, 2), F.lit(" ms")))
    return F.when(tie, F.concat(F.lit("≈ equivalent ("), text, F.lit(")"))).otherwise(F.concat(text, F.when(after < before, " faster").otherwise(" slower")))


def bytes_label(value: Column) -> Column:
    v = value.cast("double")
    return F.when(v >= 1e9, F.concat(F.format_string("%.2f", v / 1e9), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.0f", v / 1e6), F.lit(" MB")))


def binary_label(value: Column) -> Column:
    """Bytes in units of 1024 with one digit: 1.5KB."""
    v = value.cast("double")
    out = None
    for k, name in enumerate(("B", "KB", "MB", "GB")):
        out = (F if out is None else out).when(v < 1024.0 ** (k + 1), F.concat(_fixed(v / 1024.0**k, 1), F.lit(name)))
    return out.otherwise(F.concat(_fixed(v / 1024.0**4, 1), F.lit("TB")))


def clipped(text: Column, cap: int) -> Column:
    """The first cap characters; 0 for all."""
    return F.substring(text, 1, cap) if cap else text


def params_label(params: Column, most: int = 180) -> Column:
    shown = F.when(F.coalesce(F.length(params), F.lit(0)) == 0, "<no params>").otherwise(params)
    return F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 3), F.lit("..."))).otherwise(shown)


# ---- quantile rules --------------------------------------------------------------------------------------------------
# Index of the value in ascending order, from 0, of n values; the linear rule interpolates at (n - 1) q.


def _index(rule: str, n: Column, q: float) -> Column:
    if rule == "nearest":
        return F.round((n - 1) * F.lit(q)).cast("long")
    if rule == "lower":
        return F.floor((n - 1) * F.lit(q)).cast("long")
    if rule == "half_even":
        return F.least(n - 1, F.bround((n - 1) * F.lit(q)).cast("long"))
    if rule == "floor_np":
        return F.least(n - 1, F.floor(n * F.lit(q)).cast("long"))
    raise ValueError(rule)


#: Cells of a group's values: so many for each factor of e, so that a long tail doesn't put the rest into one cell.
FINE, MIDDLE = 1024, 1_000_000


def _cell(v: Column) -> Column:
    """A number that never falls as v grows; NaN is last."""
    size = F.floor(F.least(F.log(F.abs(v)) * FINE, F.lit(900_000.0))) + MIDDLE
    return F.when(F.isnan(v), 2 * MIDDLE).when(v > 0, size).when(v < 0, -size).otherwise(0).cast("int")


def first_reaching(counted: DataFrame, keys: list[str], weight: str, needs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each key and name the least v at which the cumulated weight reaches needs[name](total weight): counted is (keys, v, weight), with
    each v once for a key. Keys must not be null.

    A group's values never meet in one task: weights are summed by cell, the running sums over cells tell which cell a need falls into, and
    only the values of such cells are cumulated.
    """
    celled = counted.where(F.col("v").isNotNull()).withColumn("cell", _cell(F.col("v")))
    cells = celled.groupBy(*keys, "cell").agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    run = cells.select(*keys, "cell", "w", upto.alias("upto"), F.sum("w").over(Window.partitionBy(*keys)).alias("total"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), need(F.col("total")).cast("double").alias("need")) for name, need in needs.items()))
    before = F.col("upto") - F.col("w")
    # the last cell takes what rounding leaves above the total
    hit = F.filter(wanted, lambda x: (x["need"] <= F.col("upto")) & ((x["need"] > before) | (before <= 0)))
    hits = run.select(*keys, "cell", before.alias("before"), hit.alias("wanted")).where(F.size("wanted") > 0)
    inside = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = celled.join(hits, [*keys, "cell"]).withColumn("cum", F.col("before") + F.sum(weight).over(inside))

    def reached(name: str) -> Column:
        ours = F.exists("wanted", lambda x: x["name"] == name)
        far = F.exists("wanted", lambda x: (x["name"] == name) & (F.col("cum") >= x["need"]))
        return F.coalesce(F.min(F.when(far, F.col("v"))), F.max(F.when(ours, F.col("v")))).alias(name)

    return held.groupBy(*keys).agg(*map(reached, needs))


def _needs(rule: str, quantiles: dict[str, float]) -> dict[str, Callable[[Column], Column]]:
    if rule != "linear":
        return {name: (lambda n, q=q: _index(rule, n, q) + 1) for name, q in quantiles.items()}
    place = lambda n, q: (n - 1) * F.lit(q)
    low = {f"{name}_lo": (lambda n, q=q: F.floor(place(n, q)) + 1) for name, q in quantiles.items()}
    return low | {f"{name}_hi": (lambda n, q=q: F.ceil(place(n, q)) + 1) for name, q in quantiles.items()}


#: Aggregates of the value that its counts tell.
TOLD = {
    "rows": lambda: F.sum("c"),
    "mean": lambda: F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum(F.when(F.col("v").isNotNull(), F.col("c")))),
    "min": lambda: F.min("v"),
    "max": lambda: F.max("v"),
    "sum": lambda: F.sum(F.col("v") * F.col("c")),
}


def with_quantiles(df: DataFrame, keys: list[str], value: str | Column, rule: str, quantiles: dict[str, float], told: dict[str, str], times: str | None = None) -> DataFrame:
    """One row a key: told (name to rows, mean, min, max or sum of value) and the quantiles of value by the rule; nulls of value count among
    rows only. Keys must not be null. Without keys there is one row, also for an empty df. times: a row stands for so many.

    df is read once: values are counted by key first (a partial aggregate, one shuffle), and all else follows from the counts.
    """
    ours = keys or ["_all"]
    v = F.col(value) if isinstance(value, str) else value
    counted = df.select(*(F.col(k) for k in keys), *([] if keys else [F.lit(1).alias("_all")]), v.cast("double").alias("v"), (F.col(times) if times else F.lit(1)).cast("long").alias("c")).groupBy(*ours, "v").agg(F.sum("c").alias("c"))
    ranks = first_reaching(counted, ours, "c", _needs(rule, quantiles))
    if rule == "linear":
        n = counted.where("v is not null").groupBy(*ours).agg(F.sum("c").alias("_n"))
        at = {name: (F.col("_n") - 1) * F.lit(q) for name, q in quantiles.items()}
        lo, hi = (lambda m: F.col(f"{m}_lo")), (lambda m: F.col(f"{m}_hi"))
        ranks = ranks.join(n, ours).select(*ours, *((lo(m) + (hi(m) - lo(m)) * (p - F.floor(p))).alias(m) for m, p in at.items()))
    plain = counted.groupBy(*ours).agg(*(TOLD[how]().alias(name) for name, how in told.items()), F.lit(1).alias("_one"))
    if keys:
        return plain.join(ranks, keys, "left").drop("_one")
    # one row a side; an empty df has none, and gets nulls and 0 rows
    zero = df.sparkSession.range(1).select(F.lit(1).alias("_all"))
    out = zero.join(plain, "_all", "left").join(ranks, "_all", "left")
    return out.select(*((F.coalesce(F.col(name), F.lit(0)) if how == "rows" else F.col(name)).alias(name) for name, how in told.items()), *quantiles)
