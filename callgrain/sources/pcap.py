"""Packet captures: packets as a Spark data source, connections folded one key at a time, HTTP messages, requests paired with responses by time."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import CALLS_COLUMNS, CALLS_SCHEMA
from .files import capture_files, opened
from .rows import build_rows, client_address, decoded

FIN, SYN, RST, ACK = 1, 2, 4, 16
PACKETS = "file_idx int, pkt_idx long, ts double, src binary, dst binary, sport int, dport int, seq long, flags int, payload binary"
PACKET_NAMES = [c.split()[0] for c in PACKETS.split(", ")]
PACKET_TYPES = [pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
#: Bytes of packets in a batch.
BATCH = 4 << 20
# Link types that carry bare IP, and the header lengths of the two cooked ones.
BARE, COOKED, COOKED2 = (12, 14, 101), 113, 276


def network(frame: bytes, link: int) -> bytes:
    """The IP packet in a link-layer frame."""
    if link in BARE:
        return frame
    if link == COOKED:
        return frame[16:] if frame[14:16] in (b"\x08\x00", b"\x86\xdd") else b""
    if link == COOKED2:
        return frame[20:] if frame[:2] in (b"\x08\x00", b"\x86\xdd") else b""
    at, kind = 14, frame[12:14]
    while kind in (b"\x81\x00", b"\x88\xa8"):
        kind, at = frame[at + 2 : at + 4], at + 4
    return frame[at:] if kind in (b"\x08\x00", b"\x86\xdd") else b""


def segment(ip: bytes) -> tuple[bytes, bytes, int, int, int, int, bytes] | None:
    """src, dst, sport, dport, seq, flags and payload of a TCP segment in an IP packet, None for anything else."""
    try:
        if ip[0] >> 4 == 4:
            head, total = (ip[0] & 15) * 4, int.from_bytes(ip[2:4], "big")
            if ip[9] != 6 or int.from_bytes(ip[6:8], "big") & 0x1FFF:
                return None
            src, dst, tcp = ip[12:16], ip[16:20], ip[head : total or len(ip)]
        elif ip[0] >> 4 == 6:
            if ip[6] != 6:
                return None
            src, dst, tcp = ip[8:24], ip[24:40], ip[40 : 40 + int.from_bytes(ip[4:6], "big")]
        else:
            return None
        sport, dport, seq, _, offset, flags = struct.unpack(">HHIIBB", tcp[:14])
        return bytes(src), bytes(dst), sport, dport, seq, flags, bytes(tcp[(offset >> 4) * 4 :])
    except (IndexError, struct.error):
        return None


def packets(path: str, port: int) -> Iterator[tuple]:
    """(pkt_idx, ts, src, dst, sport, dport, seq, flags, payload) of TCP segments from or to the port; a cut tail ends the file."""
    with opened(path) as f:
        magic = f.read(4)
        order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
        unit = 1e9 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e6
        rest = f.read(20)
        if len(rest) < 20:
            return
        link = struct.unpack(f"{order}I", rest[16:20])[0] & 0xFFFF
        i = 0
        while len(head := f.read(16)) == 16:
            seconds, fraction, size, _ = struct.unpack(f"{order}IIII", head)
            frame = f.read(size)
            if len(frame) < size:
                return
            s = segment(network(frame, link))
            if s and port in (s[2], s[3]):
                yield (i, seconds + fraction / unit, *s)
            i += 1


class PcapSource(DataSource):
    """format("pcap") with options port and paths (one a line): packets, a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema):
        return PcapReader(self.options["paths"].split("\n"), int(self.options["port"]))


class PcapReader(DataSourceReader):
    def __init__(self, paths: list[str], port: int):
        self.paths, self.port = paths, port

    def partitions(self):
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition):
        i, path = partition.value
        held, size = [], 0
        for p in packets(path, self.port):
            held.append((i, *p))
            if (size := size + 100 + len(p[-1])) > BATCH:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), PACKET_TYPES, strict=True)], names=PACKET_NAMES)


def packets_of(spark: SparkSession, paths: list[str], port: int) -> DataFrame:
    spark.dataSource.register(PcapSource)
    return spark.read.format("pcap").option("paths", "\n".join(paths)).option("port", port).load()


# ---- streams and messages --------------------------------------------------------------------------------------------


@dataclass
class Half:
    """One direction: payloads by stream offset. Offsets count from the SYN's number, or from the first segment if none was seen."""

    origin: int | None = None
    syn: bool = False
    parts: dict[int, tuple[float, bytes]] = field(default_factory=dict)

    def take(self, seq: int, payload: bytes, ts: float, syn: bool) -> None:
        if syn:
            self.origin, self.syn = seq, True
        elif self.origin is None:
            self.origin = seq
        offset = (seq - self.origin - self.syn) % (1 << 32)
        if payload and offset < 1 << 31:
            self.parts.setdefault(offset, (ts, payload))  # a retransmission doesn't replace what came first

    def stream(self) -> bytes:
        """What follows without a gap from offset 0; segments that only overlap aren't merged."""
        out, at = [], 0
        while (part := self.parts.get(at)) is not None:
            out.append(part[1])
            at += len(part[1])
        return b"".join(out)

    def clock(self):
        offsets = sorted(self.parts)
        times = [self.parts[o][0] for o in offsets]

        def at(offset: int) -> float | None:
            k = bisect.bisect_right(offsets, offset)
            return times[k - 1] if k else None

        return at


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(out)


@dataclass
class Message:
    start: int
    end: int
    first: str
    headers: dict[str, str]
    text: str


def head_of(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("latin1").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def messages(stream: bytes) -> Iterator[Message]:
    """HTTP/1.1 messages of one direction in order; the first that isn't whole ends them."""
    at = 0
    while (end := stream.find(b"\r\n\r\n", at)) >= 0:
        first, headers = head_of(stream[at:end])
        body = end + 4
        if headers.get("transfer-encoding", "").lower() == "chunked":
            mark = stream.find(b"\r\n0\r\n\r\n", body)
            if mark < 0:
                return
            stop = mark + 7
            raw = unchunked(stream[body:stop])
        else:
            declared = headers.get("content-length", "")
            stop = body + (int(declared) if declared.isdigit() else 0)
            if stop > len(stream):
                return
            raw = stream[body:stop]
        yield Message(at, stop, first, headers, decoded(raw, headers.get("content-encoding", "")))
        at = stop


def paired(client: Half, server: Half, banned: frozenset[str], most_ms: float | None) -> tuple[list[dict], int, int]:
    """One dict for each POST request that isn't banned, with its response; how many were banned; how many pairs were implausible.

    A request takes the first response left that starts no earlier than itself; what isn't POST, or is banned, takes none. With f responses
    before request i, that is the one at i + max over j <= i of (f_j - j), the closed form that pair_responses has for tables.
    """
    sent, came = client.clock(), server.clock()
    wanted = [(m, w) for m in messages(client.stream()) if len(w := m.first.split(" ")) > 1 and w[0] == "POST"]
    asked = [(m, w[1]) for m, w in wanted if not banned or client_address(m.headers, "") not in banned]
    answers = list(messages(server.stream()))
    starts, begun = np.array([sent(m.start) for m, _ in asked], np.float64), np.array([came(m.start) for m in answers], np.float64)
    ends = np.array([came(m.end - 1) for m in answers], np.float64)
    i = np.arange(len(asked))
    at = i + np.maximum.accumulate(np.searchsorted(np.maximum.accumulate(begun), starts, "left") - i)
    found = np.flatnonzero(at < len(answers))
    took = (ends[at[found]] - starts[found]) * 1000
    late = took > most_ms if most_ms else np.zeros(len(found), bool)
    partner = dict(zip(found[(took >= 0) & ~late].tolist(), at[found[(took >= 0) & ~late]].tolist(), strict=True))
    flows = []
    for n, (m, path) in enumerate(asked):
        answer = answers[partner[n]] if n in partner else None
        line = answer.first.split(" ") if answer else []
        status = int(line[1]) if len(line) > 1 and line[1].isdigit() else None
        end = float(ends[partner[n]]) if answer else None
        flows.append({"request": m.text, "response": answer.text if answer else "", "start": float(starts[n]), "end": end, "status": status, "host": m.headers.get("host", ""), "path": path})
    return flows, len(wanted) - len(asked), int(late.sum())


def connections(batches: Iterator[pa.RecordBatch], port: int) -> Iterator[tuple[tuple[int, int, int], Half, Half]]:
    """Packets sorted by connection key and capture order to (ordinal, client, server). The ordinal orders connections as they end: by the
    packet that ends them, and those that never end last, by their first packet. One connection is held at a time."""
    key = state = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["conn"] != key:
                if state:
                    yield (1, *state["first"]), state["client"], state["server"]
                key, state = row["conn"], None
            at = (row["file_idx"], row["pkt_idx"])
            to_server, flags = row["dport"] == port, row["flags"]
            if state and to_server and flags & SYN and not flags & ACK and not (state["client"].syn and state["client"].origin == row["seq"]):
                yield (0, *at), state["client"], state["server"]  # the ports are used again
                state = None
            if state is None:
                state = {"client": Half(), "server": Half(), "closed": set(), "first": at}
            state["client" if to_server else "server"].take(row["seq"], row["payload"], row["ts"], bool(flags & SYN))
            if flags & FIN:
                state["closed"].add(to_server)
            if flags & RST or len(state["closed"]) == 2:
                yield (0, *at), state["client"], state["server"]
                state = None
    if state:
        yield (1, *state["first"]), state["client"], state["server"]


_INNER = [c for c in CALLS_COLUMNS if c[0] != "flow_id"]
FOLDED = "open int, file_idx int, pkt_idx long, k long, n long, skipped long, scrubbed long, rows array<struct<" + ",".join(f"{n}:{t}" for n, t in _INNER) + ">>"


def _folded(port: int, banned: frozenset[str], most_ms: float | None):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(FOLDED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ordinal, client, server in connections(batches, port):
            flows, skipped, scrubbed = paired(client, server, banned, most_ms)
            out = []
            for k, f in enumerate(flows or [None]):
                rows = build_rows(0, f["request"], f["response"], start=f["start"], end=f["end"], status=f["status"], host=f["host"], path=f["path"]) if f else []
                named = [dict(zip([n for n, _ in CALLS_COLUMNS], r, strict=True)) for r in rows]
                for r in named:
                    del r["flow_id"]
                out.append((*ordinal, k, len(flows), skipped if k == 0 else 0, scrubbed if k == 0 else 0, named))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return run


def _by_connection(raw: DataFrame) -> DataFrame:
    ends = [F.concat(a, F.lpad(F.hex(p), 8, "0").cast("binary")) for a, p in ((F.col("src"), F.col("sport")), (F.col("dst"), F.col("dport")))]
    conn = F.when(ends[0] <= ends[1], F.concat(ends[0], ends[1])).otherwise(F.concat(ends[1], ends[0]))
    return raw.withColumn("conn", conn).repartition("conn").sortWithinPartitions("conn", "file_idx", "pkt_idx")


def folded(raw: DataFrame, port: int, banned: tuple[str, ...] = (), most_ms: float | None = 60_000.0) -> DataFrame:
    """Flows of packets, a row each with its calls; connections without flows give one row with n = 0."""
    return _by_connection(raw).mapInArrow(_folded(port, frozenset(banned), most_ms), FOLDED)


def numbered(flows: DataFrame) -> DataFrame:
    """Calls with flow_id from 1 in the order in which connections end. Flows are counted by the file in which that happens, so numbering runs
    in one task for each file, over connections only, and only the files' sums are cumulated together."""
    per = flows.where("k = 0").select("open", "file_idx", "pkt_idx", "n")
    files = per.groupBy("open", "file_idx").agg(F.sum("n").alias("s"))
    before = files.select("open", "file_idx", (F.sum("s").over(Window.orderBy("open", "file_idx")) - F.col("s")).alias("base"))
    inside = Window.partitionBy("open", "file_idx").orderBy("pkt_idx")
    first = per.withColumn("lead", F.sum("n").over(inside) - F.col("n")).join(before, ["open", "file_idx"]).select("open", "file_idx", "pkt_idx", (F.col("base") + F.col("lead")).alias("base"))
    rows = flows.where("n > 0").join(first, ["open", "file_idx", "pkt_idx"]).select((F.col("base") + F.col("k") + 1).alias("flow_id"), F.explode("rows").alias("r"))
    return rows.select("flow_id", "r.*").select(*(f.name for f in CALLS_SCHEMA))


def convert(spark: SparkSession, path: str | list[str], workdir: str, port: int, banned: tuple[str, ...] = (), most_ms: float | None = 60_000.0) -> DataFrame:
    """A capture, or an archive of them, as calls."""
    return numbered(folded(packets_of(spark, capture_files(path, workdir), port), port, banned, most_ms))


# ---- truncation ------------------------------------------------------------------------------------------------------

TRUNCATION = "src string, method string, path string, declared long, body_seen long, headers_complete boolean, close string"


def _truncations(port: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ipaddress

        key, half, far, closed, out = None, Half(), 0, set(), []

        def settle() -> None:
            if key is None:
                return
            head, at = [], 0
            while at in half.parts and at <= 65536:
                head.append(half.parts[at][1])
                at += len(head[-1])
            block, mark, _ = b"".join(head).partition(b"\r\n\r\n")
            close = "RST" if "RST" in closed else "FIN" if "FIN" in closed else "none"
            src = str(ipaddress.ip_address(key[0]))
            if not mark:
                out.append((src, "?", "?", -1, far, False, close))
                return
            first, headers = head_of(block)
            words = first.split(" ", 2)
            method, path = words[:2] if len(words) == 3 else ("?", "?")
            try:
                declared = int(headers.get("content-length", "-1"))
            except ValueError:
                declared = -1
            out.append((src, method, path, declared, max(0, far - len(block) - 4), True, close))

        for batch in batches:
            for row in batch.to_pylist():
                if (row["src"], row["sport"]) != key:
                    settle()
                    key, half, far, closed = (row["src"], row["sport"]), Half(), 0, set()
                half.take(row["seq"], row["payload"], row["ts"], bool(row["flags"] & SYN and not row["flags"] & ACK))
                offset = (row["seq"] - half.origin - half.syn) % (1 << 32)
                if row["payload"] and offset < 1 << 31:
                    far = max(far, offset + len(row["payload"]))  # a gap counts as sent
                    if offset > 65536:
                        half.parts.pop(offset, None)
                closed |= {n for bit, n in ((FIN, "FIN"), (RST, "RST")) if row["flags"] & bit}
        settle()
        if out:
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TRUNCATION.split(", ")])

    return run


def truncation(raw: DataFrame, port: int) -> DataFrame:
    """How much of its declared body each client address and port sent, and how it ended."""
    sent = raw.where(F.col("dport") == port).repartition("src", "sport").sortWithinPartitions("src", "sport", "file_idx", "pkt_idx")
    return sent.mapInArrow(_truncations(port), TRUNCATION)


def truncation_report(records: DataFrame) -> DataFrame:
    """Totals over requests with a declared body, how the truncated ones ended, and whether at least half ended without a reset from us."""
    cut = F.col("headers_complete") & (F.col("declared") > 0) & (F.col("body_seen") < F.col("declared"))
    have = F.col("headers_complete") & (F.col("declared") > 0)
    n = {
        "connections": F.count("*"), "no_header": F.count_if(~F.col("headers_complete")), "requests": F.count_if(have), "complete": F.count_if(have & ~cut), "truncated": F.count_if(cut),
        "zero": F.count_if(cut & (F.col("body_seen") == 0)), "partial": F.count_if(cut & (F.col("body_seen") > 0)),
        **{f"closed_{c.lower()}": F.count_if(cut & (F.col("close") == c)) for c in ("RST", "FIN", "none")},
    }
    one = records.agg(*(c.alias(k) for k, c in n.items()))
    share = F.coalesce(F.try_divide("truncated", "requests"), F.lit(0.0))
    return one.select("*", share.alias("truncated_share"), (share >= 0.5).alias("verdict"))
