"""N-gram Jaccard join by grouped prefixes.

Every document is its set of distinct word shingles. A global order puts shingles that are frequent in the corpus last (a count sketch
over all documents, of fixed size, tells them) and longer ones first, as long shingles are seldom shared by chance. Two sets that
reach the threshold share a shingle among the first ``size - ceil(threshold * size) + 1`` of either. The join:

1. documents with equal sets fall into one class; only its smallest id goes on;
2. classes with equal prefix and size fall into one group, and only the group's id is posted under each shingle of its prefix;
3. a shingle's list of groups gives group pairs of compatible sizes, each once; groups are expanded to their members;
4. lists of up to ``LIST`` members give all their pairs. A longer list gives only the pairs of a pivot, its member with the lowest place, the
   nearest to what a family of near copies shares. What links with the pivot is one ball. The list goes on while it has members outside of
   balls, but pairs within a ball are never made again. So no link between components is lost, and a large group of near copies ends with
   its first pivot instead of emitting all its pairs;
5. sizes and parity bits sift the pairs, first 512 bits a set, then, of the documents that pairs are left of, as many as follow the size of
   the set; the others are verified on the whole sets, first one for each document, then those whose ends are in different components
   still. Only sets that pairs are left of are moved. Linked pairs give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import SLICE, folded_slices, free_shuffles, joined, mixed, resting, schema, scratch, signed, slices_of, staged, text_chunks, unstage, word_hashes
from .components import components

SKETCH, SLICES, LIST, BLOCK = 1 << 24, 64, 64, 8192


def shingles(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes in ascending order, and a length for each: the bytes of its words, without what stands between
    them, so that it is the same in every text. Fewer words than width: the whole sequence."""
    buf, starts = joined(texts)
    words, begin, end = word_hashes(buf)
    cut = np.searchsorted(begin, starts)
    with np.errstate(over="ignore"):
        full = max(0, len(words) - width + 1)
        many = np.zeros(full, np.uint64)
        for i in range(width):
            many = mixed(many ^ words[i : i + full]) + np.uint64(i + 1)
    length = np.concatenate([[0], np.cumsum(end - begin)])
    size = length[width:][:full] - length[:full]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= width:
            h, at = np.unique(many[a : b - width + 1], return_index=True)
            yield h, size[a : b - width + 1][at]
        elif b > a:
            h = np.full(1, 0x5851F42D4C957F2D + int(b - a), np.uint64)
            for w in words[a:b]:
                h = mixed(h ^ w)
            yield h, length[b : b + 1] - length[a : a + 1]
        else:
            yield words[:0], begin[:0]


def _sketches(width: int):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for _, texts in text_chunks(batches):
            parts = [h for h, _ in shingles(texts, width)]
            at, times = np.unique(np.concatenate(parts) & np.uint64(SKETCH - 1), return_counts=True)
            counts[at.astype(np.int64)] += times.astype(np.uint32)
        if counts.any():
            yield slices_of(counts, SLICES, TaskContext.get().partitionId(), "uint64")

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    usual = counts.mean()
    level = np.where(counts > usual + 4 * np.sqrt(usual + 1), np.log2(counts + 1.0) * 6, 0)
    return np.clip(level, 0, 255).astype(np.uint8)


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """One byte for each of the sketch's counters: 0 for what chance explains, else the logarithm of the count. 16 MB at every input size;
    the driver gets these bytes, not the counts."""
    found = folded_slices(docs.select("text").mapInArrow(_sketches(width), schema(SLICE)), "uint64", np.add, _levels)
    return np.concatenate([np.frombuffer(found[k], np.uint8) for k in range(SLICES)]) if found else np.zeros(SKETCH, np.uint8)


BITS = [f"b{i}" for i in range(8)]


def _sum(x: np.ndarray, salt: int) -> int:
    with np.errstate(over="ignore"):
        return int(signed(mixed(x ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True))[0])


def _fine(h: np.ndarray) -> bytes | None:
    """Parity bits of a set's elements over two to four places for each; null where 512 are as many as its elements. Halves of neighbouring
    places fold into one, so bits of any two sets compare."""
    if len(h) <= 512:
        return None
    k = int(2 * len(h) - 1).bit_length()
    return np.packbits((np.bincount((h >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1).astype(np.uint8)).tobytes()


def _parted(x: np.ndarray, y: np.ndarray) -> int:
    """In how many places two sets' fine bits (unpacked) differ: at most the elements in which the sets do."""
    if len(x) > len(y):
        x, y = y, x
    return int((np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1) != x).sum())


def _described(width: int, percent: int, levels: np.ndarray):
    """doc_id, set size, a 128-bit signature of the set, the prefix in the global order and its signature, 512 parity bits of the set, and finer ones."""

    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            n, one, two, p1, p2, prefix, fine = [], [], [], [], [], [], []
            bits = np.zeros((len(texts), 512), np.uint8)
            for i, (h, size) in enumerate(shingles(texts, width)):
                n.append(len(h))
                one.append(_sum(h, 0xA5A5A5A5A5A5A5A5))
                two.append(_sum(h, 0x0123456789ABCDEF))
                keep = len(h) - -(-len(h) * percent // 100) + 1 if len(h) else 0
                first = h[np.lexsort((h, -size, levels[(h & np.uint64(SKETCH - 1)).astype(np.int64)]))[:keep]]
                p1.append(_sum(first, 0xA5A5A5A5A5A5A5A5))
                p2.append(_sum(first, 0x0123456789ABCDEF))
                prefix.append(first.tobytes())
                fine.append(_fine(h))
                bits[i] = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=512) & 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part["doc_id"].cast(pa.int64())}
                | {k: pa.array(v, pa.int64()) for k, v in (("n", n), ("one", one), ("two", two), ("p1", p1), ("p2", p2))}
                | {"prefix": pa.array(prefix, pa.binary()), "fine": pa.array(fine, pa.binary())}
                | {k: pa.array(np.ascontiguousarray(words[:, i])) for i, k in enumerate(BITS)}
            )

    return run


@resting
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 2000):
            part = batch.slice(first, 2000)
            prefix = [np.frombuffer(x, np.int64) for x in part["prefix"].to_pylist()]
            size = [len(x) for x in prefix]
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(prefix)), "doc": pa.array(np.repeat(part["doc"].to_numpy(), size)), "n": pa.array(np.repeat(part["n"].to_numpy(), size)), "place": pa.array(place)})


def _spare(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """How many elements sets of sizes x may have that sets of sizes y lack."""
    return x - -(-(x + y) * percent // (100 + percent))


def _pairs(percent: int):
    """Postings (key, doc, n, place) sorted by key, place, doc to pairs (a, b): with a null key, or, where the list is longer than LIST, with
    its key and each member b with its place.

    place is how many elements of the document's order come before the list's. If it is the first that two documents share, none of those
    is in the other, so each place is at most its size less the least intersection; pairs that can't meet this are left to the lists of
    earlier elements. A list's rows may come in any number of batches; no more than LIST of them are held.
    """

    def spare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _spare(x, y, percent)

    def short(docs: np.ndarray, n: np.ndarray, place: np.ndarray, out: list) -> None:
        order = np.argsort(n, kind="stable")
        docs, n, place = docs[order], n[order], place[order]
        for i in range(len(docs) - 1):
            last = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            if last > i + 1:
                m = n[i + 1 : last]
                meet = (place[i] <= spare(n[i], m)) & (place[i + 1 : last] <= spare(m, n[i]))
                if meet.any():
                    other = docs[i + 1 : last][meet]
                    out.append((np.repeat(docs[i], len(other)), other, None, None))

    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        held: tuple = none
        key, long = None, False

        def emit(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                plain = np.concatenate([np.full(len(x[0]), x[2] is None) for x in out])
                keys = np.concatenate([np.full(len(x[0]), x[2] or 0, np.int64) for x in out])
                place = np.concatenate([np.zeros(len(x[0]), np.int32) if x[3] is None else x[3] for x in out])
                columns = {"key": pa.array(keys, mask=plain), "a": pa.array(np.where(plain, np.minimum(a, b), a)), "b": pa.array(np.where(plain, np.maximum(a, b), b)), "place": pa.array(place)}
                yield pa.RecordBatch.from_pydict(columns)

        def star(docs: np.ndarray, n: np.ndarray, place: np.ndarray, out: list) -> None:
            out.append((np.full(len(docs), held[0][0]), docs, int(key), place))

        for batch in batches:
            columns = [batch[x].to_numpy() for x in ("doc", "n", "place")]
            keys = batch["key"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
            out: list = []
            runs = np.diff(edges)
            # single rows inside the batch can't pair; only its first and last run may go on in another batch
            for j in sorted({*np.flatnonzero(runs > 1).tolist(), 0, len(runs) - 1}) if len(runs) else []:
                s, e = int(edges[j]), int(edges[j + 1])
                if keys[s] != key or key is None:
                    if not long:
                        short(*held, out)
                    key, long, held = keys[s], False, none
                rows = tuple(c[s:e] for c in columns)
                if long:
                    star(*rows, out)
                    continue
                held = tuple(np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
                if len(held[0]) > LIST:
                    long = True
                    star(*held, out)
            yield from emit(out)
        if not long:
            out = []
            short(*held, out)
            yield from emit(out)

    return run


LISTED = "key long, a long, b long, place int"


def _near(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of x (docs, n, place, bits, and a ball or 0) which of y sizes, places and parity bits let link with it, and no ball has both.

    The parity of a set's elements over 512 places differs in at most as many places as two sets differ in elements.
    """
    for i, (doc, n, place, bits, ball) in enumerate(zip(*x, strict=True)):
        m = y[1]
        good = (m * percent <= n * 100) & (n * percent <= m * 100) & (place <= _spare(n, m, percent)) & (y[2] <= _spare(m, n, percent)) & (y[0] != doc) & ((y[4] != ball) | (ball == 0))
        at = np.flatnonzero(good)
        if len(at):
            h = np.bitwise_count(y[3][at] ^ bits).sum(axis=1, dtype=np.int64)
            at = at[h * (100 + percent) <= (m[at] + n) * (100 - percent)]
            if len(at):
                yield i, at


def _plain_batch(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), np.int32))], names=["key", "a", "b", "place"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, rows) of consecutive rows with one key; a list may come in several parts."""
    for batch in batches:
        keys = batch["key"].to_numpy()
        if len(keys):
            columns = [*(batch[c].to_numpy() for c in ("doc", "n", "place")), np.stack([batch[c].to_numpy() for c in BITS], axis=1).view(np.uint64), batch["ball"].to_numpy()]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]).tolist()
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield int(keys[s]), [c[s:e] for c in columns]


def _stars(percent: int):
    """Lists sorted by key, place, doc to pairs with a null key. A list of more than LIST members gives only those of its pivot, the first
    member, and all members with the key and the pivot. No more than LIST members are held."""

    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, long, held = None, False, None

        def pairs(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if out := [(np.full(len(at), x[0][i]), y[0][at]) for i, at in _near(x, y, percent)]:
                yield _plain_batch(out)

        def settled() -> Iterator[pa.RecordBatch]:
            if held is not None and not long:
                out = [(np.full(len(at), held[0][i]), held[0][at]) for i, at in _near(held, held, percent)]
                if out := [(x[y > x], y[y > x]) for x, y in out if (y > x).any()]:
                    yield _plain_batch(out)

        def members(part: list[np.ndarray]) -> pa.RecordBatch:
            n = len(part[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, held[0][0])), pa.array(part[0]), pa.array(part[2])], names=["key", "a", "b", "place"])

        for k, part in _runs(batches):
            if k != key or key is None:
                yield from settled()
                key, long, held = k, False, None
            if not long:
                held = part if held is None else [np.concatenate([x, y]) for x, y in zip(held, part, strict=True)]
                if len(held[0]) <= LIST:
                    continue
                long, part, held = True, held, [c[:1] for c in held]
            yield from pairs(held, part)
            yield members(part)
        yield from settled()

    return run


def _blocks(percent: int):
    """Lists of at most two blocks of members, told by side, to the pairs across sides, or all if there is but one; all are held."""

    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def sided() -> Iterator[pa.RecordBatch]:
            if held is None:
                return
            # place holds the side in its lowest bit here
            side = held[2] & 1
            rows = [held[0], held[1], held[2] >> 1, held[3], held[4]]
            x, y = ([c[side == 0] for c in rows], [c[side == 1] for c in rows]) if side.any() else (rows, rows)
            out = []
            for i, at in _near(x, y, percent):
                other = y[0][at] if side.any() else y[0][at][y[0][at] > x[0][i]]
                if len(other):
                    out.append((np.full(len(other), x[0][i]), other))
                if len(out) > 20_000:
                    yield _plain_batch(out)
                    out = []
            if out:
                yield _plain_batch(out)

        for k, part in _runs(batches):
            if k != key or key is None:
                yield from sided()
                key, held = k, part
            else:
                held = [np.concatenate([x, y]) for x, y in zip(held, part, strict=True)]
        yield from sided()

    return run


def _sets(width: int):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc": part["doc_id"].cast(pa.int64()), "items": pa.array([h.tobytes() for h, _ in shingles(texts, width)], pa.binary())})

    return run


def _refined(percent: int):
    """Pairs (a, b) with sizes and fine bits (x, y) to those that may link; a set without fine bits may."""

    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            total = batch["na"].to_numpy() + batch["nb"].to_numpy()
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                if x.is_valid and y.is_valid:
                    differ = _parted(*(np.unpackbits(np.frombuffer(z.as_buffer(), np.uint8)) for z in (x, y)))
                    keep[i] = differ * (100 + percent) <= int(total[i]) * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


@resting
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, union = [], []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            both.append(same)
            union.append(len(x) + len(y) - same)
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "same": pa.array(both, pa.int64()), "union": pa.array(union, pa.int64())})


PAIR = "key long, a long, b long, place int"


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z folded. Sets link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id reachable, itself included.

    Nulls and empty texts: the set is empty and links with nothing, component_id is the row's own doc_id. Rows that share a doc_id are one
    document and thereby linked. Rows with a null doc_id keep their size, have a null component and take no part. An empty table gives no
    rows; other columns are ignored, whatever their names. Very long texts are hashed in windows.
    """
    with scratch() as keep:
        return keep(staged(_joined_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)))


def _joined_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    levels = frequency_levels(docs, width)
    free_shuffles(docs.sparkSession)
    kind = "doc_id long, n long, one long, two long, p1 long, p2 long, prefix binary, fine binary, " + ", ".join(f"{b} long" for b in BITS)
    all_docs = staged(docs.mapInArrow(_described(width, percent, levels), schema(kind)))
    live = all_docs.where("n > 0 and doc_id is not null").withColumnRenamed("doc_id", "doc")
    classes = staged(live.groupBy("one", "two", "n").agg(F.min("doc").alias("doc")))
    members = live.join(classes, ["one", "two", "n", "doc"]).dropDuplicates(["one", "two", "n", "doc"])
    grouped = staged(members.select("doc", "n", "p1", "p2", *BITS))
    ids = staged(grouped.groupBy("p1", "p2", "n").agg(F.min("doc").alias("doc")))
    groups = live.select("p1", "p2", "n", "doc", "prefix").join(ids, ["p1", "p2", "n", "doc"]).select("doc", "n", "prefix").mapInArrow(_postings, schema("key long, doc long, n long, place int"))
    member_of = staged(grouped.select("doc", "n", "p1", "p2").join(ids.withColumnRenamed("doc", "group"), ["p1", "p2", "n"]).select("group", "doc", "n"))

    def sifted(lists: DataFrame, work) -> DataFrame:
        """lists: (key, doc, place, ball), to what work makes of each."""
        full = lists.join(grouped.select("doc", "n", *BITS), "doc").select("key", "place", "doc", "n", F.coalesce("ball", F.lit(0)).alias("ball"), *BITS)
        return staged(full.repartition("key").sortWithinPartitions("key", "place", "doc").mapInArrow(work(percent), schema(LISTED)))

    differ = " + ".join(f"bit_count(x{k} ^ y{k})" for k in BITS)

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs with both sizes and h, the places in which the parities of their sets differ: at most the elements in which the sets do."""
        x = grouped.select(F.col("doc").alias("a"), F.col("n").alias("na"), *(F.col(k).alias(f"x{k}") for k in BITS))
        y = grouped.select(F.col("doc").alias("b"), F.col("n").alias("nb"), *(F.col(k).alias(f"y{k}") for k in BITS))
        return pairs.join(x, "a").join(y, "b").withColumn("h", F.expr(differ)).drop(*(f"{s}{k}" for s in "xy" for k in BITS))

    near = f"h * {100 + percent} <= (na + nb) * {100 - percent} and least(na, nb) * 100 >= greatest(na, nb) * {percent} and a <> b"

    # group pairs, each once; a hot shingle's list keeps its key and is expanded as a list
    first = staged(groups.repartition("key").sortWithinPartitions("key", "place", "doc").mapInArrow(_pairs(percent), schema(PAIR)))
    free_shuffles(docs.sparkSession)
    crowds = member_of.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    cold = first.where("key is null").select("a", "b").distinct()
    marked = cold.join(crowds.select(F.col("group").alias("a"), F.lit(True).alias("ca")), "a", "left").join(crowds.select(F.col("group").alias("b"), F.lit(True).alias("cb")), "b", "left")
    marked = staged(marked.select("a", "b", (F.col("ca").isNotNull() | F.col("cb").isNotNull()).alias("crowd")))
    plain = compared(marked.where("not crowd").select("a", "b")).where(near).select("a", "b")
    wide = marked.where("crowd").select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("group"), F.lit(0).alias("place"))
    own = crowds.select(F.xxhash64("group").alias("key"), "group", F.lit(0).alias("place"))
    hot = first.where("key is not null").select("key", F.col("b").alias("group"), "place")
    lists = wide.unionByName(own).unionByName(hot).distinct().join(member_of, "group").select("key", "doc", "place", F.lit(None).cast("long").alias("ball"))
    pairs = sifted(lists, _stars)
    found = staged(pairs.where("key is null").select("a", "b").unionByName(plain).distinct())
    unstage(first, marked)
    free_shuffles(docs.sparkSession)

    stars = pairs.where("key is not null")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(stars.select("a", "b")).select(F.explode(F.array("a", "b")).alias("doc")).distinct()

    fine = live.select("doc", "one", "two", "n", "fine").join(staged(ends(found)), "doc", "left_semi")
    fine = staged(fine.groupBy("doc", "one", "two", "n").agg(F.first("fine").alias("fine")).select("doc", "n", "fine"))

    def refined(found: DataFrame) -> DataFrame:
        """The pairs that fine bits let link. Rows that share a doc_id are told apart by nothing here, so any of them may."""
        if found.isEmpty():
            return found
        x = fine.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("fine").alias("x"))
        y = fine.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("y"))
        return staged(found.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_refined(percent), schema("a long, b long")).distinct())

    found = refined(found)
    need = ends(found).withColumnRenamed("doc", "doc_id")
    texts = docs.join(need.hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.first("text").alias("text"))
    sets = staged(texts.select("doc_id", "text").mapInArrow(_sets(width), schema("doc long, items binary")))

    def verified(found: DataFrame, old: DataFrame | None) -> DataFrame:
        if found.isEmpty():  # else the sets are moved for nothing
            return staged(found.select("a", "b")) if old is None else old
        x, y = (sets.join(found.select(F.col(end).alias("doc")), "doc", "left_semi").select(F.col("doc").alias(end), F.col("items").alias(items)) for end, items in (("a", "x"), ("b", "y")))
        told = found.join(x, "a").join(y, "b")
        checked = told.select("a", "b", "x", "y").mapInArrow(_verified, schema("a long, b long, same long, union long"))
        good = checked.where(f"100 * same >= {percent} * union").select("a", "b").distinct()
        return staged(good if old is None else old.unionByName(good))

    def rooted(df: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        return df

    def topped(up: DataFrame) -> DataFrame:
        """Pointers (node, root), one a node, followed eight steps."""
        for _ in range(3):
            up = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return staged(up)

    def linked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links, and a root that each linked document is in one component with. A pair whose ends are known to be in one component says
        nothing new: twice one pair a document is verified, then what that leaves."""
        if found.isEmpty():
            return found.select("a", "b"), found.select(F.col("a").alias("node"), F.col("b").alias("root"))
        rest = found.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
        links: DataFrame | None = None
        roots: DataFrame | None = None
        for _ in range(2):
            forest = staged(rest.groupBy("b").agg(F.min(F.struct("a", "ca", "cb")).alias("m")).select("m.a", "b", "m.ca", "m.cb"))
            trees = verified(forest.select("a", "b"), None)
            good = forest.join(trees, ["a", "b"])
            up = topped(good.select(F.greatest("ca", "cb").alias("node"), F.least("ca", "cb").alias("root")).groupBy("node").agg(F.min("root").alias("root")))
            links = trees if links is None else links.unionByName(trees)
            rest = rest.join(forest.select("a", "b"), ["a", "b"], "left_anti")
            rest = staged(rooted(rest.select("a", "b", F.col("ca").alias("x"), F.col("cb").alias("y")), up, "x", "y").where("cx <> cy").select("a", "b", F.col("cx").alias("ca"), F.col("cy").alias("cb")))
            # roots of documents: those of their former roots
            roots = up if roots is None else staged(roots.withColumnRenamed("root", "r").join(up.select(F.col("node").alias("r"), "root"), "r", "left").select("node", F.coalesce("root", "r").alias("root")).unionByName(up.join(roots, "node", "left_anti")))
            if rest.isEmpty():
                break
        return verified(rest.select("a", "b"), links), roots

    def balled(stars: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of long lists; those that link with the pivot are its ball, as is the pivot."""
        direct = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("linked", F.lit(True))
        told = rooted(stars, roots, "a", "b").join(direct, ["a", "b"], "left")
        ours = F.col("linked").isNotNull() | (F.col("ca") == F.col("cb")) | (F.col("a") == F.col("b"))
        return staged(told.select("key", F.col("b").alias("doc"), "place", F.when(ours, F.col("a")).alias("ball")))

    edges, roots = linked(found)
    if not stars.isEmpty():
        members = balled(stars, edges, roots)
        # further families of near copies in what is outside of a long list's ball; this only saves pairs, the blocks below leave nothing out
        for _ in range(3):
            outside = members.where("ball is null")
            many = outside.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > LIST).select("key")
            more = sifted(outside.join(many, "key"), _stars)
            again = more.where("key is not null")
            if again.isEmpty():
                break
            links, roots = linked(refined(staged(more.where("key is null").select("a", "b").distinct())))
            edges = edges.unionByName(links)
            new = balled(again, links, roots).select("key", "doc", F.col("ball").alias("new"))
            members = staged(members.join(new, ["key", "doc"], "left").select("key", "doc", "place", F.coalesce("ball", "new").alias("ball")))
            free_shuffles(docs.sparkSession)
        # every two members of a long list that no ball has both: in blocks, each with itself and each other, by sizes, places and parities
        size = members.groupBy("key").agg(F.count("*").alias("k"), F.countDistinct(F.coalesce("ball", F.col("doc"))).alias("parts")).where("parts > 1").select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
        dealt = members.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("mine") > F.col("other"), 1).otherwise(0)
        cut = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "doc", (F.col("place") * 2 + side).cast("int").alias("place"), "ball")
        crossed = sifted(cut, _blocks)
        links, roots = linked(refined(staged(crossed.select("a", "b").distinct())))
        edges = edges.unionByName(links)
    edges = staged(edges.distinct())
    free_shuffles(docs.sparkSession)
    # rows that share a doc_id tie the classes of their texts
    ours = live.select("one", "two", "n", F.col("doc").alias("doc_id"))
    tied = ours.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    same_id = ours.join(tied, "doc_id").join(classes, ["one", "two", "n"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).where("a <> b")
    found = components(edges.unionByName(same_id))
    labels = classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("one", "two", "n", F.coalesce("component", "doc").alias("component"))
    out = all_docs.select("doc_id", "n", "one", "two").join(labels, ["one", "two", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.least("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
