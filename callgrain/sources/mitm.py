"""Proxy dumps: tnetstring frames of flows, plain or zstd-compressed, as a Spark data source and as calls rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import CALLS_SCHEMA
from .files import opened
from .rows import build_rows, call_count, client_address, decoded

#: Bytes of frames in a batch.
BATCH = 4 << 20


def frames(stream) -> Iterator[bytes]:
    """Raw frames `length:payload type`, unparsed; a cut tail ends the stream."""
    while True:
        digits = b""
        while (c := stream.read(1)) and c != b":":
            if not c.isdigit() or len(digits) > 12:
                return
            digits += c
        if not c or not digits:
            return
        size = int(digits) + 1
        body = stream.read(size)
        if len(body) < size:
            return
        yield digits + b":" + body


def parse(frame: bytes) -> Any:
    """A tnetstring's value: , bytes; ; text; # whole number; ^ float; ! boolean; ~ null; ] list; } mapping with text keys."""
    value, rest = _value(memoryview(frame))
    if len(rest):
        raise ValueError("more than one value")
    return value


def _value(data: memoryview) -> tuple[Any, memoryview]:
    head = bytes(data[:13]).split(b":", 1)[0]
    size, at = int(head), len(head) + 1
    body, kind, rest = data[at : at + size], bytes(data[at + size : at + size + 1]), data[at + size + 1 :]
    if kind == b",":
        return bytes(body), rest
    if kind == b";":
        return bytes(body).decode("utf-8"), rest
    if kind == b"#":
        return int(bytes(body)), rest
    if kind == b"^":
        return float(bytes(body)), rest
    if kind == b"!":
        return bytes(body) == b"true", rest
    if kind == b"~":
        return None, rest
    items = []
    while len(body):
        item, body = _value(body)
        items.append(item)
    if kind == b"]":
        return items, rest
    if kind == b"}":
        keys = [k.decode("utf-8", "replace") if isinstance(k, bytes) else k for k in items[::2]]
        return dict(zip(keys, items[1::2], strict=True)), rest
    raise ValueError(f"unknown type {kind!r}")


def dump(value: Any) -> bytes:
    """The tnetstring of a value."""
    if value is None:
        body, kind = b"", b"~"
    elif isinstance(value, bool):
        body, kind = (b"true" if value else b"false"), b"!"
    elif isinstance(value, int):
        body, kind = str(value).encode(), b"#"
    elif isinstance(value, float):
        body, kind = repr(value).encode(), b"^"
    elif isinstance(value, bytes):
        body, kind = value, b","
    elif isinstance(value, str):
        body, kind = value.encode(), b";"
    elif isinstance(value, dict):
        body, kind = b"".join(dump(k) + dump(v) for k, v in value.items()), b"}"
    else:
        body, kind = b"".join(map(dump, value)), b"]"
    return str(len(body)).encode() + b":" + body + kind


def _text(x: Any) -> str | None:
    return x.decode("utf-8", "replace") if isinstance(x, bytes) else x


def headers(pairs: Any) -> dict[str, str]:
    """Lower-case names; of equal names the last."""
    return {_text(k).lower(): _text(v) for k, v in pairs or ()}


class MitmSource(DataSource):
    """format("mitm") with option paths (one a line): (flow_id, frame) of dumps; flow_id counts a dump's frames from 1, and those of the k-th
    dump after the first from k * 2^40 + 1. A dump can't be split, so files are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "mitm"

    def schema(self) -> str:
        return "flow_id long, frame binary"

    def reader(self, schema):
        return MitmReader(self.options["paths"].split("\n"))


class MitmReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition((k, p)) for k, p in enumerate(self.paths)]

    def read(self, partition):
        k, path = partition.value
        with opened(path) as stream:
            held, size, at = [], 0, (k << 40) + 1
            for frame in frames(stream):
                held.append(frame)
                if (size := size + len(frame)) > BATCH:
                    yield self._batch(at, held)
                    held, size, at = [], 0, at + len(held)
            if held:
                yield self._batch(at, held)

    @staticmethod
    def _batch(at: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.binary())], names=["flow_id", "frame"])


def flow_of(frame: bytes) -> dict | None:
    """The fields of a flow that queries use; None for what is no HTTP flow."""
    try:
        flow = parse(frame)
    except (ValueError, IndexError, UnicodeDecodeError):
        return None
    request = flow.get("request") if isinstance(flow, dict) else None
    if not request:
        return None
    response = flow.get("response") or {}
    peer = ((flow.get("client_conn") or {}).get("peername") or (flow.get("client_conn") or {}).get("address") or [None])[0]
    hq, hr = headers(request.get("headers")), headers(response.get("headers"))
    return {
        "method": _text(request.get("method")), "host": _text(request.get("host")), "path": _text(request.get("path")), "headers": hq, "peer": _text(peer),
        "raw": request.get("content") or b"", "request": decoded(request.get("content"), hq.get("content-encoding", "")), "response": decoded(response.get("content"), hr.get("content-encoding", "")),
        "start": request.get("timestamp_start"), "end": response.get("timestamp_end"), "status": response.get("status_code") if response else None,
        "has_response": bool(flow.get("response")), "has_error": bool(flow.get("error")), "ended": request.get("timestamp_end") is not None,
        "upstream": bool((flow.get("server_conn") or {}).get("timestamp_tcp_setup")),
    }


def _rows(banned: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(CALLS_SCHEMA)
        for batch in batches:
            rows = []
            for flow_id, frame in zip(batch["flow_id"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                f = flow_of(frame)
                if f is None or f["method"] != "POST" or client_address(f["headers"], f["peer"]) in banned:
                    continue
                rows += build_rows(flow_id, f["request"], f["response"], start=f["start"], end=f["end"], status=f["status"], host=f["host"], path=f["path"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)

    return run


def frames_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    spark.dataSource.register(MitmSource)
    return spark.read.format("mitm").option("paths", path if isinstance(path, str) else "\n".join(path)).load()


def convert(spark: SparkSession, path: str | list[str], banned: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """A dump, or several, as calls. Framing is sequential; parsing, its great part, runs in `partitions` tasks."""
    raw = frames_of(spark, path)
    raw = raw.repartition(partitions or spark.sparkContext.defaultParallelism, "flow_id")
    return raw.mapInArrow(_rows(frozenset(banned)), CALLS_SCHEMA)


def write_calls(calls: DataFrame, path: str, compression: str = "zstd", row_group_bytes: int = 128 << 20) -> None:
    if compression not in ("zstd", "snappy", "gzip", "none"):
        raise ValueError(f"unknown compression {compression}")
    calls.write.option("compression", "uncompressed" if compression == "none" else compression).option("parquet.block.size", row_group_bytes).parquet(path)


# ---- capture health ---------------------------------------------------------------------------------------------------

FLOW_FACTS = "flow_id long, http_method string, declared long, body_bytes long, served boolean, upstream boolean, user_agent string, ts_start double, parsed boolean, calls long"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FLOW_FACTS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.float64(), pa.bool_(), pa.int64()]
    for batch in batches:
        rows = []
        for flow_id, frame in zip(batch["flow_id"].to_pylist(), batch["frame"].to_pylist(), strict=True):
            f = flow_of(frame)
            if f is None:
                rows.append((flow_id, None, None, 0, False, False, None, None, False, 0))
                continue
            length = f["headers"].get("content-length", "")
            rows.append((flow_id, f["method"], int(length) if re.fullmatch(r"\d{1,18}", length.strip()) else 0, len(f["raw"]), f["has_response"] and not f["has_error"] and f["ended"], f["upstream"], f["headers"].get("user-agent", ""), f["start"], (calls := call_count(f["request"])) is not None, calls or 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def flow_facts(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    raw = frames_of(spark, path).repartition(partitions or spark.sparkContext.defaultParallelism, "flow_id")
    return raw.mapInArrow(_facts, FLOW_FACTS)


def classified(facts: DataFrame) -> DataFrame:
    """What became of each flow: delivered, aborted (client gone), capture_gap (served, body not captured), empty_ok, non_post, non_http."""
    empty = F.col("body_bytes") == 0
    return facts.withColumn(
        "class",
        F.when(F.col("http_method").isNull(), "non_http").when(F.col("http_method") != "POST", "non_post").when(~empty, "delivered")
        .when(F.coalesce("declared", F.lit(0)) == 0, "empty_ok").when(F.col("served"), "capture_gap").otherwise("aborted"),
    )


def delivery_rate():
    """Percent of the flows that bear a body whose body is there; 0 without such flows."""
    return F.coalesce(F.try_divide("delivered", F.col("delivered") + F.col("aborted") + F.col("capture_gap")) * 100, F.lit(0.0))


def health(classes: DataFrame, gap_pct: float = 1.0) -> DataFrame:
    """Counts by class on one row, delivery rate and share of gaps, and whether the gaps stay under gap_pct."""
    n = {c: F.count_if(F.col("class") == c).alias(c) for c in ("delivered", "aborted", "capture_gap", "empty_ok", "non_post", "non_http")}
    one = classes.agg(*n.values(), F.count_if((F.col("class") == "aborted") & F.col("upstream")).alias("aborted_upstream"))
    posts = F.col("delivered") + F.col("aborted") + F.col("capture_gap") + F.col("empty_ok")
    gap = F.coalesce(F.try_divide("capture_gap", posts) * 100, F.lit(0.0))
    return one.select("*", delivery_rate().alias("delivered_pct"), gap.alias("gap_pct"), (gap < gap_pct).alias("verdict"))


def health_by(classes: DataFrame, what: str, n: int = 12) -> DataFrame:
    """Counts of delivered, aborted and missed flows by user agent (its first word) or by hour since the epoch."""
    classes = classes.where("class in ('delivered', 'aborted', 'capture_gap')" + (" and ts_start <> 0" if what == "hour" else ""))
    agent = F.split(F.when(F.coalesce("user_agent", F.lit("")) == "", "<none>").otherwise(F.col("user_agent")), " ")[0]
    key = agent.alias("user_agent") if what == "user_agent" else F.floor(F.col("ts_start") / 3600).alias("hour")
    out = classes.groupBy(key).agg(F.count("*").alias("flows"), *(F.count_if(F.col("class") == c).alias(c) for c in ("delivered", "aborted", "capture_gap"))).withColumn("delivered_pct", delivery_rate())
    return out.orderBy(F.desc("flows"), "user_agent").limit(n) if what == "user_agent" else out
