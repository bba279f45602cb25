"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by SHA-256. The ledger holds what each rule, in its version, found in a blob. A run scans
only the pairs of blob and rule version that the ledger lacks, each blob once however many paths and versions share it, and joins the
findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .base import staged


@dataclass(frozen=True)
class Rule:
    """A Java pattern; of its leftmost non-overlapping matches those count whose group `part` has `least` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    version: int = 1


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: hex and access are written with the bound in the pattern: their runs are maximal, so that is the same as dropping short matches.
BASE = (Rule("assign", _ASSIGN, 2, 8), Rule("access", "AKIA[A-Z0-9]{12,}"), Rule("hex", "[0-9a-f]{32,}"))
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points, end exclusive. The pieces between matches and the matches, in turn, give the offsets."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast(SPANS)
    pairs = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    kept = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.part)) >= rule.least) if rule.part else (lambda m: F.length(m) >= rule.least)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & kept(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE + MORE) -> tuple[DataFrame, DataFrame]:
    """versions (path, version, content) and a ledger to (findings, additions).

    findings has a row for each row of versions: path, version, blob, spans by start, then rule. additions are the ledger's new rows
    (blob binary, kind, rule_version, spans) for the pairs that it lacks; append them to it. Without a ledger all pairs are new. Both are
    read from tables in the shared folder that this call writes: the scan runs here, once.

    A null content is the empty blob. Repeated rows, null paths or versions and copies keep a row each. An empty table gives no rows;
    other columns are ignored. Hot copies are pre-aggregated to one blob by hash; contents move once, by a key that no copies share.
    """
    v = versions.select("path", "version", F.coalesce("content", F.lit("")).alias("content")).withColumn("blob", F.unhex(F.sha2(F.col("content"), 256)))
    here = v.select("path", "version", "blob")
    blobs = here.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    wanted = blobs.select("blob", "at", F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules)).alias("todo"))
    if ledger is not None:
        pairs = wanted.select("blob", "at", F.explode("todo").alias("t")).select("blob", "at", "t.*")
        pairs = pairs.join(ledger.select("blob", "kind", "rule_version"), ["blob", "kind", "rule_version"], "left_anti")
        wanted = pairs.groupBy("blob", "at").agg(F.collect_set(F.struct("kind", "rule_version")).alias("todo"))
    wanted = wanted.select(F.col("blob").alias("b"), F.col("at.path").alias("p"), F.col("at.version").alias("w"), "todo")
    # one content for each blob: the first path's; the smaller side is built, the contents stream by
    same = F.col("blob").eqNullSafe(F.col("b")) & F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("w"))
    content = v.join(wanted.hint("shuffle_hash"), same).select("blob", "todo", "content")
    text = F.col("content")
    # a row is one scanned pair; rows of versions that are repeated whole scan a blob again, so pairs are made distinct
    each = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), spans(text, r, i).alias("spans")) for i, r in enumerate(rules)))
    if ledger is not None:
        each = F.array_compact(F.array(*(F.when(F.array_contains(F.transform("todo", lambda t: t["kind"]), r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), spans(text, r, i).alias("spans"))) for i, r in enumerate(rules))))
    scanned = content.select("blob", each.alias("found"))
    # written once: it is the ledger's growth, and what the findings are read from
    additions = staged(scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.*").dropDuplicates(["blob", "kind", "rule_version"]))
    current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules))
    known = additions if ledger is None else additions.unionByName(ledger.select("blob", "kind", "rule_version", "spans").where(F.array_contains(current, F.struct("kind", "rule_version"))))
    # only blobs with findings are joined back, and from a table, so that Spark can split a hot blob's paths
    by_blob = staged(known.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    found = here.join(by_blob, "blob", "left").select("path", "version", "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))
    return found, additions


def as_text(column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
