"""Fuzzy line dedup over a corpus by a deletion-neighbourhood join, one edit apart.

Two lines of one edit agree once the edited place is deleted. Emitting every deletion of every line would multiply the corpus by its line length,
so the places that can matter are narrowed first, without losing a pair:

1. lines are hashed; equal ones are one class with the earliest position;
2. a line's two halves are keys (for its own length and the next, as the partner may be longer). Only a line that shares a half with a
   different line can have a partner; a Bloom filter of fixed size carries the shared halves back to a pass over the text. It errs on the
   side of more lines;
3. for those lines, keys of all but one eighth tell in which eighth the edit would be;
4. the deletion variants of that eighth are emitted as hashed keys: with their place, which substitutions share, and alone, which meet the
   whole shorter line of an insertion. A variant's group needs only its earliest line, no pairs;
5. the edit distance of each late line to its earliest witness is verified on the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .base import SLICE, WINDOW, folded_slices, mixed, resting, schema, signed, slices_of, staged, text_chunks, unstage

BASE = np.uint64(0x9E3779B97F4A7C1F)
UNDO = np.uint64(pow(0x9E3779B97F4A7C1F, -1, 1 << 64))
PARTS = 8
FILTER_BITS, SLICES = 1 << 25, 16
LAST = 2**63 - 1


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


class Hashed:
    """Polynomial hashes of all lines of some texts: any slice's hash is two look-ups. Power tables are as long as the texts together."""

    def __init__(self, lines: list[str]):
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            up = np.concatenate([np.ones(1, np.uint64), np.full(len(chars), BASE)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(len(chars) + 1, UNDO)]).cumprod(dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(chars + np.uint64(77)) * up[:-1], dtype=np.uint64)])
        self.size = np.array([len(x) for x in lines], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def slices(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the characters from a to b, absolute places."""
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a]

    def without(self, rows: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        """Keys of lines without their characters a to b, relative, as lines of the given size would have them."""
        s = self.start[rows]
        with np.errstate(over="ignore"):
            x = mixed(self.slices(s, s + a) + np.uint64(kind)) ^ mixed(self.slices(s + b, s + self.size[rows]) * np.uint64(3) + size.astype(np.uint64))
            return mixed(x + a.astype(np.uint64))


def part_keys(h: Hashed, rows: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, longer, part) for each row: for lines of the row's own length, and one longer (whose part is one character wider than ours)."""
    out = []
    n = h.size[rows]
    for longer in (0, 1):
        size = n + longer
        for q in range(parts):
            a, b = q * size // parts, (q + 1) * size // parts
            if longer:
                b = np.maximum(b - 1, a)
            out.append((h.without(rows, size, a, b, 11 + q), np.full(len(rows), longer), np.full(len(rows), q)))
    return out


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of chunks of rows (doc_id, rk, text): doc_id, rk, line number and normal line of the lines that are long enough."""
    for part, texts in text_chunks(batches):
        doc, rk, no, lines, held = [], [], [], [], 0
        for d, k, text in zip(part["doc_id"].to_pylist(), part["rk"].to_pylist(), texts, strict=True):
            for i, line in enumerate(text.decode("utf-8", "replace").split("\n")):
                if len(line) >= least and len(line := normal(line)) >= least:
                    doc.append(d)
                    rk.append(k)
                    no.append(i)
                    lines.append(line)
                    if (held := held + len(line)) > WINDOW:
                        yield np.array(doc, np.int64), np.array(rk, np.int64), np.array(no, np.int64), lines
                        doc, rk, no, lines, held = [], [], [], [], 0
        if lines:
            yield np.array(doc, np.int64), np.array(rk, np.int64), np.array(no, np.int64), lines


def _identity(h: Hashed) -> tuple[np.ndarray, np.ndarray]:
    x = h.slices(h.start, h.start + h.size)
    with np.errstate(over="ignore"):
        return signed(mixed(x + h.size.astype(np.uint64))), signed(mixed(x * np.uint64(5) ^ h.size.astype(np.uint64)) ^ mixed(h.slices(h.start, h.start + h.size // 3)))


def _hashed(least: int):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, rk, no, lines in _lines(batches, least):
            h = Hashed(lines)
            one, two = _identity(h)
            keys = [signed(k) for k, _, _ in part_keys(h, np.arange(len(lines)), 2)]
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "rk": rk, "no": no, "h1": one, "h2": two} | {f"k{i}": k for i, k in enumerate(keys)})

    return run


def _places(keys: np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64)
    return np.concatenate([x % np.uint64(FILTER_BITS), (x >> np.uint64(32)) % np.uint64(FILTER_BITS)]).astype(np.int64)


@resting
def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[_places(batch["key"].to_numpy())] = True
    if bits.any():
        yield slices_of(np.packbits(bits), SLICES, TaskContext.get().partitionId(), "uint8")


def bloom(keys: DataFrame) -> bytes:
    """A Bloom filter of 4 MB, whatever the number of keys."""
    found = folded_slices(keys.mapInArrow(_filtered, schema(SLICE)), "uint8", np.bitwise_or)
    return zlib.compress(b"".join(found[k] for k in range(SLICES)) if found else bytes(FILTER_BITS // 8), 1)


def _candidates(least: int, packed: bytes):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).view(bool)
        for doc, rk, no, lines in _lines(batches, least):
            h = Hashed(lines)
            hit = np.zeros(len(lines), bool)
            for k, _, _ in part_keys(h, np.arange(len(lines)), 2):
                hit |= bits[_places(k)].reshape(2, -1).all(axis=0)
            at = np.flatnonzero(hit)
            one, two = _identity(h)
            yield pa.RecordBatch.from_pydict({"h1": one[at], "h2": two[at], "doc_id": doc[at], "rk": rk[at], "no": no[at], "line": pa.array([lines[i] for i in at], pa.string())})

    return run


@resting
def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 4000):
            part = batch.slice(first, 4000)
            h = Hashed(part["line"].to_pylist())
            rows = np.arange(len(part))
            found = part_keys(h, rows, PARTS)
            many = len(found)
            yield pa.RecordBatch.from_pydict(
                {"key": signed(np.concatenate([k for k, _, _ in found])), "longer": np.concatenate([x for _, x, _ in found]).astype(np.int32), "q": np.concatenate([x for _, _, x in found]).astype(np.int32)}
                | {c: np.tile(part[c].to_numpy(), many) for c in ("h1", "h2")}
            )


@resting
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, pos, line, spots) to (key, role, h1, h2, pos): role 0 substitutions, 1 the longer line of an insertion, 2 the shorter."""
    for batch in batches:
        for first in range(0, len(batch), 1000):
            part = batch.slice(first, 1000)
            h = Hashed(part["line"].to_pylist())
            row, key, role = [], [], []
            for i, spots in enumerate(part["spots"].to_pylist()):
                s, n = int(h.start[i]), int(h.size[i])
                for spot in set(spots):
                    longer, q = divmod(spot, PARTS)
                    with np.errstate(over="ignore"):
                        if longer:
                            key.append(mixed(h.slices(np.array([s]), np.array([s + n])) + np.uint64(n)))
                            role.append(np.full(1, 2))
                            row.append(np.full(1, i))
                            continue
                        p = np.arange(q * n // PARTS, (q + 1) * n // PARTS)
                        # the polynomial without the character at p: what follows moves one place down
                        v = (h.sums[s + p] - h.sums[s]) * h.down[s] + (h.sums[s + n] - h.sums[s + p + 1]) * h.down[s + 1]
                        key += [mixed(mixed(v + np.uint64(n)) + p.astype(np.uint64) + np.uint64(1 << 40)), mixed(v + np.uint64(n - 1))]
                    role += [np.zeros(len(p), np.int64), np.ones(len(p), np.int64)]
                    row += [np.full(len(p), i)] * 2
            if row:
                at = np.concatenate(row)
                yield pa.RecordBatch.from_pydict({"key": signed(np.concatenate(key)), "role": np.concatenate(role).astype(np.int32)} | {c: part[c].take(pa.array(at)) for c in ("h1", "h2", "doc_id", "rk", "no")})


def one_edit(x: str, y: str) -> bool:
    """Whether at most one insertion, deletion or substitution apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) < len(y):
        x, y = y, x
    lo, hi = 0, len(y)
    while lo < hi:  # the longest common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid - 1)
    return x[lo + 1 :] == y[lo + (len(x) == len(y)) :]


@resting
def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [i for i, (x, y) in enumerate(zip(batch["line"].to_pylist(), batch["other"].to_pylist(), strict=True)) if one_edit(x, y)]
        yield batch.select(["h1", "h2"]).take(pa.array(keep, pa.int64()))


@resting
def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n, gone = [], [], []
        for text, drop in zip(batch["text"].to_pylist(), batch["_drop"].to_pylist(), strict=True):
            lines = (text or "").split("\n")
            out = set(drop or ())
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
            n.append(len(lines) if text else 0)
            gone.append(len(out))
        names = [c for c in batch.schema.names if c != "_drop"]
        columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(gone, pa.int32())], names=[*names, "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, least: int = 20) -> DataFrame:
    """docs (doc_id, text and any others) with text less its late lines, and n_lines and n_dropped.

    Lines are what stands between line feeds; they are compared in lower case with white space runs as one space, and only those of at least
    `least` characters then. A line is late if an earlier line equals it or is one edit away; earlier is by doc_id, then by its row, then by
    place. Late lines are dropped, the earliest of all stays. Shorter lines always stay.

    Nulls and empty texts stay as they are; rows with a null doc_id come after all others; rows that are equal in doc_id and text are one
    document in this, so they keep the same lines. All other columns stay; n_lines and n_dropped of docs are replaced. An empty table gives
    no rows. Long lines are hashed by their prefix sums; a very long text is held whole by one task.
    """
    docs = docs.drop("n_lines", "n_dropped", "_drop", "_rk")
    keyed = docs.withColumn("_rk", F.xxhash64("doc_id", "text"))
    slim = keyed.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("_rk").alias("rk"), "text")
    at = "doc_id long, rk long, no long"
    lines = staged(slim.mapInArrow(_hashed(least), schema(f"{at}, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")))

    halves = lines.select(F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"), F.shiftright("h1", 32).cast("int").alias("h"))
    shared = halves.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    found = slim.mapInArrow(_candidates(least, bloom(shared)), schema(f"h1 long, h2 long, {at}, line string"))
    # of equal lines the earliest, with its text
    candidates = staged(found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rk", "no")).alias("pos"), F.first("line").alias("line")).select("h1", "h2", "pos.*", "line"))
    part_rows = staged(candidates.select("h1", "h2", "line").mapInArrow(_part_rows, schema("key long, longer int, q int, h1 long, h2 long")))
    common = part_rows.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    spots = part_rows.join(common, "key").groupBy("h1", "h2").agg(F.collect_set(F.col("longer") * PARTS + F.col("q")).alias("spots"))
    variants = staged(candidates.join(spots, ["h1", "h2"]).mapInArrow(_variants, schema(f"key long, role int, h1 long, h2 long, {at}")))
    pos = F.struct("doc_id", "rk", "no", "h1", "h2")
    first = variants.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, pos)).alias(f"r{r}") for r in range(3)))
    # substitutions: the group's earliest; an insertion: the longer lines' earliest for the shorter, the shorter for the longer
    witness = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    late = variants.join(first.where("r2 is null or r1 is not null"), "key").select("h1", "h2", pos.alias("pos"), witness.alias("w")).where("w < pos")
    late = late.groupBy("h1", "h2").agg(F.min("w").alias("w")).select("h1", "h2", F.col("w.h1").alias("w1"), F.col("w.h2").alias("w2"))
    texts = candidates.select("h1", "h2", "line")
    told = late.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("line").alias("other")), ["w1", "w2"])
    near = staged(told.select("h1", "h2", "line", "other").mapInArrow(_edited, schema("h1 long, h2 long")))
    unstage(variants, part_rows)

    again = lines.groupBy("h1", "h2").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "rk", "no")).alias("keep")).where("k > 1")
    gone = again.select("h1", "h2", "keep", F.lit(False).alias("all")).unionByName(near.select("h1", "h2", F.lit(None).cast(again.schema["keep"].dataType).alias("keep"), F.lit(True).alias("all")))
    # written, so that the join below stands directly on its exchanges and Spark can split a hot line
    gone = staged(gone.groupBy("h1", "h2").agg(F.max("keep").alias("keep"), F.max("all").alias("all")))
    drops = lines.select("doc_id", "rk", "no", "h1", "h2").join(gone, ["h1", "h2"]).where(F.col("all") | (F.col("keep") != F.struct("doc_id", "rk", "no")))
    drops = staged(drops.groupBy("rk").agg(F.collect_set(F.col("no").cast("int")).alias("_drop")).withColumnRenamed("rk", "_rk"))
    unstage(lines, candidates, near, gone)
    out = keyed.join(drops.hint("shuffle_hash"), "_rk", "left").drop("_rk")
    kept = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_dropped", T.IntegerType())])
    return out.mapInArrow(_cleaned, kept)
