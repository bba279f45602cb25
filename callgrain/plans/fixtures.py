"""The driver's tables written as what the sources read: proxy dumps, packet captures and monitoring responses, in the shared folder.

An order is a flow whose calls are its lines. What a flow is like follows from its number: see `KIND` and the SQL beside the queries.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import mitm, pcap
from ..sources.files import shared_dir, written
from . import bridge

#: flow_id modulo 13: what isn't listed is a POST with a whole body.
KIND = {0: "no json", 1: "get", 2: "aborted", 3: "gap", 4: "empty", 5: "tcp"}
FILES, CONNECTIONS, PORT, GAP, LATER = 8, 499, 3456, 200, 15


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_id, ts_start, duration_ms, http_status, request and response text; answers come in the reverse order of their calls."""
    c = bridge.calls(spark, sf_dir, wide=False)
    text = lambda s: F.lit(s)
    q = F.concat(text('{"id":'), "position", text(',"method":"'), "method", text('"'), F.coalesce(F.concat(text(',"params":'), "params_json"), text("")), text("}"))
    error = F.concat(text(',"error":{"code":'), "error_code", text(',"message":"'), "error_message", text('","data":['), "position", text("]}"))
    a = F.concat(text('{"id":'), "position", F.coalesce(F.concat(text(',"result":'), "result_json"), error, text("")), text("}"))
    # as many as an order has lines
    per = c.groupBy("flow_id").agg(
        F.sort_array(F.collect_list(F.struct("position", q.alias("q"), a.alias("a")))).alias("x"), F.first("ts_start").alias("ts_start"), F.first("duration_ms").alias("duration_ms"), F.first("http_status").alias("http_status")
    )
    join = lambda items: F.when(F.size("x") == 1, F.element_at(items, 1)).otherwise(F.concat(text("["), F.array_join(items, ","), text("]")))
    return per.select("flow_id", "ts_start", "duration_ms", "http_status", join(F.transform("x", lambda i: i["q"])).alias("request"), join(F.transform(F.reverse("x"), lambda i: i["a"])).alias("response"))


def _flow(r: dict) -> dict:
    n, kind = r["flow_id"], KIND.get(r["flow_id"] % 13)
    if kind == "tcp":
        return {"type": "tcp", "client_conn": {"peername": ["10.9.9.9", 1]}}
    content = {"no json": b"no json", "aborted": b"", "gap": b"", "empty": b""}.get(kind, r["request"].encode())
    headers = [[b"X-Forwarded-For", f"10.0.0.{n % 5}, 10.8.8.8".encode()], [b"User-Agent", f"agent{n % 7} v1".encode()]]
    if n % 3 == 1 and content and not kind:
        content = gzip.compress(content)
        headers.append([b"Content-Encoding", b"gzip"])
    headers += [] if kind == "empty" else [[b"Content-Length", str(len(content) or 66).encode()]]
    response = None
    if kind == "gap" or (kind not in ("aborted", "empty") and r["http_status"] is not None):
        response = {"status_code": r["http_status"] or 200, "headers": [], "content": r["response"].encode(), "timestamp_end": r["ts_start"] + (r["duration_ms"] or 0.0) / 1000}
    request = {"method": "GET" if kind == "get" else "POST", "host": "node", "path": f"/o/{n}", "headers": headers, "content": content, "timestamp_start": r["ts_start"], "timestamp_end": r["ts_start"]}
    return {"type": "http", "request": request, "response": response, "client_conn": {"peername": ["10.9.9.9", 1]}, "server_conn": {"timestamp_tcp_setup": 1.0 if n % 2 == 0 else None}}


def _dumped(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            open_ = {}
            for batch in batches:
                for r in batch.to_pylist():
                    if r["file"] not in open_:
                        path = f"{folder}/{r['file']:03d}.mitm" + (".zst" if r["file"] % 2 else "")
                        open_[r["file"]] = (path, stack.enter_context(written(path)))
                    open_[r["file"]][1].write(mitm.dump(_flow(r)))
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in open_.values()], pa.string())})

    return run


def dumps(spark: SparkSession, sf_dir: str) -> list[str]:
    """FILES dumps, every other one compressed; returns their paths."""
    at = folder(spark, "dumps")
    flows = bodies(spark, sf_dir).withColumn("file", F.pmod("flow_id", F.lit(FILES)).cast("int"))
    return sorted(r.path for r in flows.repartition(FILES, "file").sortWithinPartitions("file", "flow_id").mapInArrow(_dumped(at), "path string").collect())


# ---- captures


def _packet(client: tuple[bytes, int], server: tuple[bytes, int], to_server: bool, seq: int, flags: int, ts: float, payload: bytes = b"") -> bytes:
    a, b = (client, server) if to_server else (server, client)
    tcp = struct.pack(">HHIIBBHHH", a[1], b[1], seq % (1 << 32), 0, 5 << 4, flags, 1000, 0, 0) + payload
    frame = b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + a[0] + b[0] + tcp
    return struct.pack("<IIII", int(ts), round(ts % 1 * 1e6), len(frame), len(frame)) + frame


HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
SERVER = (bytes([10, 0, 0, 1]), PORT)


def _segments(message: bytes, seq: int, again: bool) -> list[tuple[int, bytes]]:
    """In pieces of 1400 bytes; again: the first two swapped and the first sent twice."""
    out = [(seq + i, message[i : i + 1400]) for i in range(0, len(message), 1400)]
    return [*out[1:2], out[0], out[0], *out[2:]] if again else out


def _answer(n: int, text: bytes, status: int) -> bytes:
    if n % 4 == 0:
        cut = len(text) // 2
        chunks = b"".join(f"{len(c):x}\r\n".encode() + c + b"\r\n" for c in (text[:cut], text[cut:]) if c)
        return f"HTTP/1.1 {status} OK\r\nTransfer-Encoding: chunked\r\n\r\n".encode() + chunks + b"0\r\n\r\n"
    packed = gzip.compress(text) if n % 4 == 1 else text
    return f"HTTP/1.1 {status} OK\r\nContent-Length: {len(packed)}\r\n{'Content-Encoding: gzip' + chr(13) + chr(10) if n % 4 == 1 else ''}\r\n".encode() + packed


def _captured(folder: str):
    """Rows (part, conn, rank, ...) by part, rank and conn to two captures a part: connections that last go over both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, seqs = [], {}
        with contextlib.ExitStack() as stack:
            out, now = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    n, conn, part = r["flow_id"], r["conn"], (r["part"], int(r["rank"] >= LATER))
                    if part != now:
                        now = part
                        paths.append(f"{folder}/{part[0]:03d}-{part[1]}.pcap")
                        out = stack.enter_context(written(paths[-1]))
                        out.write(HEAD)
                    t, client = r["ts"], (bytes([10, 1, conn // 250, conn % 250 + 1]), 20000 + conn)
                    if conn not in seqs:
                        seqs[conn] = [(1 << 32) - 700 + conn, 5000]  # numbers wrap
                        out.write(_packet(client, SERVER, True, seqs[conn][0] - 1, pcap.SYN, t - 1))
                        out.write(_packet(client, SERVER, False, seqs[conn][1] - 1, pcap.SYN | pcap.ACK, t - 1))
                    body = r["request"].encode()
                    q = f"POST /o/{n} HTTP/1.1\r\nHost: node\r\nX-Forwarded-For: 10.0.0.{n % 5}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                    for side, message, at in ((0, q, t), (1, _answer(n, r["response"].encode(), 500 if n % 6 == 0 else 200), t + r["took"])):
                        for seq, payload in _segments(message, seqs[conn][side], n % 7 == 0):
                            out.write(_packet(client, SERVER, side == 0, seq, pcap.ACK, at, payload))
                        seqs[conn][side] += len(message)
                    if r["last"] and conn % 3 < 2:
                        out.write(_packet(client, SERVER, True, seqs[conn][0], pcap.RST if conn % 3 else pcap.FIN | pcap.ACK, t + 100))
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    return run


def captures(spark: SparkSession, sf_dir: str) -> list[str]:
    """Keep-alive connections, each flow GAP seconds after the one before; an answer takes flow_id % 90 + 0.25 seconds."""
    from pyspark.sql import Window

    at = folder(spark, "captures")
    conn = bodies(spark, sf_dir).withColumn("conn", F.pmod("flow_id", F.lit(CONNECTIONS)).cast("int"))
    by = Window.partitionBy("conn").orderBy("flow_id")
    placed = conn.withColumn("rank", F.row_number().over(by) - 1).withColumn("last", F.lead("flow_id").over(by).isNull())
    rows = placed.select("flow_id", "conn", "rank", "last", "request", "response", (F.lit(1e9) + F.col("rank") * GAP).alias("ts"), (F.pmod("flow_id", F.lit(90)) + F.lit(0.25)).cast("double").alias("took"), F.pmod("conn", F.lit(4)).alias("part"))
    return sorted(r.path for r in rows.repartition(4, "part").sortWithinPartitions("part", "rank", "conn").mapInArrow(_captured(at), "path string").collect())


def _cut(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        with contextlib.ExitStack() as stack:
            for batch in batches:
                for r in batch.to_pylist():
                    if path is None:
                        path = f"{folder}/{r['part']:03d}.pcap"
                        out = stack.enter_context(written(path))
                        out.write(HEAD)
                    n, t = r["key"], 1e9 + r["key"] % 100_000
                    client = (bytes([10, 2, n >> 16 & 255, n >> 8 & 255]), 20000 + (n & 255) + 256 * (n >> 24 & 63))
                    head = b"POST / HTTP/1.1\r\nContent-Le" if not r["whole"] else f"POST / HTTP/1.1\r\nContent-Length: {r['declared']}\r\n\r\n".encode()
                    sent = head + (b"x" * r["seen"] if r["whole"] else b"")
                    out.write(_packet(client, SERVER, True, n, pcap.SYN, t))
                    for seq, payload in _segments(sent, n + 1, False):
                        out.write(_packet(client, SERVER, True, seq, pcap.ACK, t, payload))
                    if r["close"] != "none":
                        out.write(_packet(client, SERVER, True, n + 1 + len(sent), pcap.RST if r["close"] == "RST" else pcap.FIN | pcap.ACK, t + 1))
        yield pa.RecordBatch.from_pydict({"path": pa.array([path] if path else [], pa.string())})

    return run


def cut_captures(spark: SparkSession, sf_dir: str) -> list[str]:
    """A connection an order: of the declared body so much was sent, and so it ended."""
    at = folder(spark, "cut")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey as key", "cast(case when o_orderkey % 9 = 0 then 0 else 1000 end as long) as declared", "cast(case o_orderpriority when '1-URGENT' then 0 else o_orderkey % 2000 end as long) as seen",
        "o_orderkey % 13 <> 0 as whole", "case o_orderstatus when 'F' then 'FIN' when 'O' then 'RST' else 'none' end as close", "cast(o_orderkey % 4 as int) as part",
    )
    # by range, so that each task writes one file
    return sorted(r.path for r in o.repartitionByRange(4, "part").sortWithinPartitions("part", "key").mapInArrow(_cut(at), "path string").collect())


def _responses(key: tuple, frame):
    import pandas as pd

    window, metric, to = (str(k) for k in key)
    result = [{"metric": {"mode": mode} if mode else {}, "values": [[int(t), repr(float(v))] for t, v in zip(g["t"], g["v"], strict=True)]} for mode, g in frame.sort_values(["mode", "ordinal", "t"]).groupby("mode")]
    path = f"{to}/{window}__{metric}.json"
    with written(path) as f:
        f.write(json.dumps({"status": "success", "data": {"resultType": "matrix", "result": result}}).encode())
    return pd.DataFrame({"path": [path]})


def write_points(points: DataFrame, to: str) -> list[str]:
    """Monitoring points as `<window>__<metric>.json` responses, each written by one task as it is one document; returns their paths."""
    return sorted(r.path for r in points.withColumn("to", F.lit(to)).groupBy("window", "metric", "to").applyInPandas(_responses, "path string").collect())
