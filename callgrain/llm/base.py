"""What the operators share: the shared folder, cutting lineage, and vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.files import shared_dir

#: Bytes of text that are held as numpy arrays at a time.
WINDOW = 2_000_000

_made: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
            _made.pop(path, None)


def staged(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path  # type: ignore[attr-defined]
    return back


def unstage(*frames: DataFrame) -> None:
    """Delete what staged() wrote, once nothing lazy reads it any more."""
    for df in frames:
        delete(df.sparkSession, df.staged_path)  # type: ignore[attr-defined]


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what staged() writes in the block when it ends, but for the frames given to the function it yields."""
    before, kept = set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_path)  # type: ignore[attr-defined]
        return df

    yield keep
    for path in set(_made) - before - kept:
        delete(_made[path], path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give memory that is free in this process back to the system: workers live on between stages and count as in use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which releases the worker's free memory once it is through."""

    @functools.wraps(run)
    def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return rested


#: Of a structure of fixed size that each task makes: a slice's number, the group of tasks it is folded with first, the compressed array.
SLICE = "slice int, part int, body binary"
GROUPS = 256


def slices_of(x: np.ndarray, slices: int, task: int, dtype: str) -> pa.RecordBatch:
    bodies = [zlib.compress(part.astype(dtype).tobytes(), 1) for part in np.split(x, slices)]
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([task % GROUPS] * slices, pa.int32()), pa.array(bodies, pa.binary())], names=["slice", "part", "body"])


def _folding(dtype: str, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], last: bool, finish: Callable[[np.ndarray], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def row() -> pa.RecordBatch:
            x = finish(held) if finish else held
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["slice", "part", "body"])

        for batch in batches:
            for k, part, body in zip(batch["slice"].to_pylist(), batch["part"].to_pylist(), batch["body"], strict=True):
                x = np.frombuffer(zlib.decompress(body.as_buffer()), dtype)
                now = (k, 0 if last else part)
                if now == key:
                    held = fold(held, x)
                else:
                    if key is not None:
                        yield row()
                    key, held = now, x
        if key is not None:
            yield row()

    return resting(run)


def folded_slices(parts: DataFrame, dtype: str, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[int, bytes]:
    """All tasks' slices folded into one, by number, after finish. In two levels: no task reads more than GROUPS slices or those of a
    GROUPS-th of the tasks, and each holds two at a time."""
    for last in (False, True):
        keys = ["slice"] if last else ["slice", "part"]
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_folding(dtype, fold, last, finish if last else None), schema(SLICE))
    return {r["slice"]: zlib.decompress(bytes(r["body"])) for r in parts.collect()}


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[return-value]


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null where the column is."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# ---- words as hashes -------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C1F)  # 3 mod 4, so that swapped bytes never cancel out
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64) - 1, _STEP)]).cumprod(dtype=np.uint64)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def word_hashes(buf: np.ndarray, fold: np.ndarray = LOWER, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of bytes that aren't space; in windows that end at a space, so memory stays bounded by the words."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            blank = np.flatnonzero(space[buf[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                while end < n and not space[buf[end]]:
                    more = np.flatnonzero(space[buf[end : end + WINDOW]])
                    end = end + int(more[0]) if len(more) else min(n, end + WINDOW)
        part = buf[at:end]
        ink = ~space[part]
        edge = np.diff(np.concatenate([[0], ink.view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            length = stop - start
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            inside = np.arange(int(length.sum())) - np.repeat(first, length)
            with np.errstate(over="ignore"):
                terms = _MIX[fold[part[ink]]] * powers(int(length.max()))[inside]
                hashed = mixed(np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            out.append((hashed, start + at, stop + at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


#: White space, punctuation and controls of ASCII end a word here.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals of Latin-1 in lower case."""
    out = LOWER[buf]
    if len(buf) > 1:
        upper = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = WINDOW) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about so many bytes of text (a longer text comes alone), and the texts as bytes; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not len(texts):
            continue
        lengths = np.array(texts.cast(pa.large_binary()).is_valid()).astype(np.int64)
        offsets = np.frombuffer(texts.cast(pa.large_binary()).buffers()[1], np.int64)[texts.cast(pa.large_binary()).offset :][: len(texts) + 1]
        lengths *= np.diff(offsets)
        total, first = np.cumsum(lengths), 0
        while first < len(texts):
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + size, "right")))
            part = batch.slice(first, last - first)
            yield part, [x or b"" for x in part.column(part.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]
            first = last


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line feed after each, as one array, and where each starts (with the end last)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return buf, np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
