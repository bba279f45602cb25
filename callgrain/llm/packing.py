"""Packing into windows by Karmarkar-Karp multiway differencing.

Documents are taken in groups of a partition's rows. Of each, whole windows are cut off first; the rests are dealt to k windows by differencing:
the two partial partitions with the widest imbalance are merged, largest sums against smallest, until one is left. k starts at the least that
can hold the rests and rises whenever a window exceeds the capacity. Then the emptiest windows are taken apart and cut to fill the gaps of the
others exactly, so only few documents are cut. What is left over goes on to the next group, and a partition's last rest is cut by powers of two,
which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import resting, schema, text_chunks
from .pretokens import WordEnds, encoder

#: Documents whose rests are differenced together.
GROUP = 192


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k parts with nearly equal sums."""
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []
    for i, x in enumerate(sizes):
        heap.append((-x, i, [x] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]))  # sums fall
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        parts = [x + y for x, y in zip(pa_, reversed(pb), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        sums, parts = [sums[i] for i in order], [parts[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, parts))
        tie += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing with the least window count that it fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differenced(sizes, k)
        over = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if over <= capacity:
            return [p for p in parts if p]
        k += max(1, k * (over - capacity) // (4 * capacity))


def filled(items: list[tuple[int, int, int]], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of items (document, start, length), and the items left over, fewer than capacity in all."""
    if not items:
        return [], []
    parts = [[items[i] for i in p] for p in windows([x[2] for x in items], capacity)]
    parts.sort(key=lambda p: -sum(x[2] for x in p))
    whole = sum(x[2] for x in items) // capacity
    pool = [x for p in parts[whole:] for x in p][::-1]
    full = parts[:whole]
    for p in full:
        gap = capacity - sum(x[2] for x in p)
        while gap:
            doc, start, length = pool.pop()
            took = min(gap, length)
            p.append((doc, start, took))
            if length > took:
                pool.append((doc, start + took, length - took))
            gap -= took
    return full, pool[::-1]


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, capacity: int, end_id: int):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordEnds, path)
        docs: dict[int, tuple[int | None, bytes]] = {}
        items: list[tuple[int, int, int]] = []
        sequence, seen = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        out: list[list] = [[] for _ in range(7)]

        def emit(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length in pieces:
                name, ids = docs[doc]
                for column, value in zip(out, (name, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset), strict=True):
                    column.append(value)
                offset += length
            sequence += 1

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            for x in out:
                x.clear()
            return batch

        def settle() -> None:
            nonlocal items
            full, items = filled(items, capacity)
            for pieces in full:
                emit(pieces)
            keep = {doc for doc, _, _ in items}
            for doc in [d for d in docs if d not in keep]:
                del docs[doc]

        tail = end_id.to_bytes(4, "little")
        for part, texts in text_chunks(batches):
            for name, ids in zip(part["doc_id"].cast(pa.int64()).to_pylist(), encode.encoded([x.decode("utf-8", "replace") for x in texts]), strict=True):
                docs[seen] = (name, ids + tail)
                n = len(ids) // 4 + 1
                for start in range(0, n - capacity + 1, capacity):
                    emit([(seen, start, capacity)])
                if n % capacity:
                    items.append((seen, n - n % capacity, n % capacity))
                seen += 1
                if len(items) >= GROUP:
                    settle()
                if len(out[0]) >= 1000:
                    yield flushed()
        settle()
        rest = sum(x[2] for x in items)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            pieces = []
            while size:
                doc, start, length = items.pop(0)
                took = min(size, length)
                pieces.append((doc, start, took))
                if length > took:
                    items.insert(0, (doc, start + took, length - took))
                size -= took
            emit(pieces)
        if out[0]:
            yield flushed()

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of the rows of docs (doc_id, text): doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset.

    A document is its token ids and end_id; each id lies in exactly one piece, and a sequence's pieces lie gapless from offset 0. All
    sequences hold capacity ids, but for a few of each partition that hold a power of two. sequence_id names the partition and the
    number there. No shuffle: a lost task is run again on the same rows and gives the same pieces.

    A null or empty text is end_id alone. Null doc_ids and repeated rows are packed like any row. An empty table gives no pieces; other
    columns are ignored. Of a very long text only the rest of its last window waits for others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_packed(path, capacity, end_id), schema(PIECE))
