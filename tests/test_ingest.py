import gzip
import io
import json
import struct
import tarfile

import pytest
import zstandard

from callgrain.schema import CALLS_COLUMNS
from callgrain.sources import mitm, pcap, rows

PORT, CLIENT, SERVER = 3456, bytes([10, 0, 0, 2]), bytes([10, 0, 0, 1])


# ---- packets


def packet(to_server, seq, flags, payload=b"", sport=40000, ts=100.0):
    a, b = ((CLIENT, sport), (SERVER, PORT)) if to_server else ((SERVER, PORT), (CLIENT, sport))
    tcp = struct.pack(">HHIIBBHHH", a[1], b[1], seq % (1 << 32), 0, 5 << 4, flags, 1000, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + a[0] + b[0] + tcp
    return ts, b"\0" * 12 + b"\x08\x00" + ip


def capture(path, packets_):
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for ts, frame in packets_:
            f.write(struct.pack("<IIII", int(ts), round(ts % 1 * 1e6), len(frame), len(frame)) + frame)
    return str(path)


def request(body, extra=""):
    body = body if isinstance(body, bytes) else json.dumps(body).encode()
    return f"POST /rpc/v1 HTTP/1.1\r\nHost: node\r\nContent-Length: {len(body)}\r\n{extra}\r\n".encode() + body


def response(body, status=200, extra="", length=True):
    body = body if isinstance(body, bytes) else json.dumps(body).encode()
    return f"HTTP/1.1 {status} OK\r\n{f'Content-Length: {len(body)}' + chr(13) + chr(10) if length else ''}{extra}\r\n".encode() + body


def call(i, method="eth_a", **more):
    return {"id": i, "method": method, **more}


def opening(sport=40000, isn=1000, ts=99.0):
    return [packet(True, isn, pcap.SYN, sport=sport, ts=ts), packet(False, 5000, pcap.SYN | pcap.ACK, sport=sport, ts=ts)]


def exchange(pairs, sport=40000, isn=1000, start=100.0):
    out, c, s, t = opening(sport, isn, start - 1), isn + 1, 5001, start
    for q, a in pairs:
        out.append(packet(True, c, pcap.ACK, q, sport, t))
        out.append(packet(False, s, pcap.ACK, a, sport, t + 0.5))
        c, s, t = c + len(q), s + len(a), t + 1
    return out


def converted(spark, tmp_path, packets_, **more):
    path = capture(tmp_path / "a.pcap", packets_)
    return pcap.convert(spark, path, str(tmp_path), PORT, **more).orderBy("flow_id", "position").collect()


def test_single_and_keep_alive(spark, tmp_path):
    got = converted(spark, tmp_path, exchange([(request(call(1, "m1")), response({"id": 1, "result": 7})), (request(call(2, "m2")), response({"id": 2, "result": 8}))]))
    assert [(r.flow_id, r.method, r.result_json, r.http_status, r.path, r.host) for r in got] == [(1, "m1", "7", 200, "/rpc/v1", "node"), (2, "m2", "8", 200, "/rpc/v1", "node")]
    assert all(r.duration_ms == pytest.approx(500) for r in got)


def test_batch_gzip_and_chunked(spark, tmp_path):
    batch = request([call("a"), call("b")])
    answer = gzip.compress(json.dumps([{"id": "b", "error": {"code": -32000, "message": "boom", "data": {"x": 1}}}, {"id": "a", "result": None}]).encode())
    chunked = b"5\r\n{\"id\"\r\n" + b"e\r\n:1,\"result\":3}\r\n" + b"0\r\n\r\n"
    got = converted(spark, tmp_path, exchange([(batch, response(answer, extra="Content-Encoding: gzip\r\n")), (request(call(1)), response(chunked, extra="Transfer-Encoding: chunked\r\n", length=False))]))
    assert [(r.position, r.batch_size, r.result_json, r.error_code, r.error_message, r.error_data_json) for r in got] == [(0, 2, "null", None, None, None), (1, 2, None, -32000, "boom", '{"x":1}'), (0, 1, "3", None, None, None)]


def test_archive_and_connection_over_two_files(spark, tmp_path):
    q, a = request(call(1, "split")), response({"id": 1, "result": "x" * 50})
    first = [*opening(), packet(True, 1001, pcap.ACK, q, ts=100.0), packet(False, 5001, pcap.ACK, a[:40], ts=100.2)]
    second = [packet(False, 5041, pcap.ACK, a[40:], ts=100.4), *exchange([(request(call(1, "other")), response({"id": 1, "result": 2}))], sport=40001, start=110.0)]
    names = [capture(tmp_path / f"{n}.pcap", p) for n, p in (("1", first), ("2", second))]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for n in names:
            t.add(n, arcname=n[-6:])
    archive = tmp_path / "c.tar.zst"
    archive.write_bytes(zstandard.compress(raw.getvalue()))
    work = tmp_path / "work"
    work.mkdir()
    got = pcap.convert(spark, str(archive), str(work), PORT).orderBy("flow_id").collect()
    assert [(r.flow_id, r.method, r.http_status) for r in got] == [(1, "split", 200), (2, "other", 200)]


def test_port_reuse_order_and_retransmission(spark, tmp_path):
    one = exchange([(request(call(1, "old")), response({"id": 1, "result": 1}))])
    two = exchange([(request(call(1, "new")), response({"id": 1, "result": 2}))], isn=90000, start=200.0)
    other = exchange([(request(call(1, "open")), response({"id": 1, "result": 3}))], sport=41000, start=90.0)
    again = packet(True, 1001, pcap.ACK, b"X" * 20, ts=101)
    end = [packet(True, 95000, pcap.FIN | pcap.ACK, ts=300), packet(False, 9000, pcap.FIN | pcap.ACK, ts=300)]
    got = converted(spark, tmp_path, [*other, *one, again, *two, *end])
    # connections count as they end; what never ends comes last
    assert [(r.flow_id, r.method, r.result_json) for r in got] == [(1, "old", "1"), (2, "new", "2"), (3, "open", "3")]


def test_pairing_by_time_scrub_and_bans(spark, tmp_path):
    q, early, late = request(call(1)), response({"id": 1, "result": "early"}), response({"id": 1, "result": "late"})
    got = converted(spark, tmp_path, [*opening(), packet(False, 5001, pcap.ACK, early, ts=50.0), packet(True, 1001, pcap.ACK, q, ts=100.0), packet(False, 5001 + len(early), pcap.ACK, late, ts=101.0)])
    assert [(r.result_json, r.duration_ms) for r in got] == [('"late"', pytest.approx(1000))]
    slow = [*opening(), packet(True, 1001, pcap.ACK, q, ts=100.0), packet(False, 5001, pcap.ACK, late, ts=199.0)]
    (r,) = converted(spark, tmp_path, slow)
    assert (r.result_json, r.duration_ms, r.http_status) == (None, None, None)
    (r,) = converted(spark, tmp_path, slow, most_ms=None)
    assert r.duration_ms > 60000
    pairs = [(request(call(1, "bad"), "X-Forwarded-For: 1.2.3.4, 5.6.7.8\r\n"), b""), (b"GET / HTTP/1.1\r\n\r\n", b""), (request(call(2, "good")), response({"id": 2, "result": 5}))]
    got = converted(spark, tmp_path, exchange(pairs), banned=("1.2.3.4",))
    assert [(r.flow_id, r.method, r.result_json) for r in got] == [(1, "good", "5")]


def test_link_layers():
    _, frame = packet(True, 1, 0)
    ip = frame[14:]
    for link, data in ((1, frame), (101, ip), (14, ip), (113, b"\0" * 14 + b"\x08\x00" + ip), (276, b"\x08\x00" + b"\0" * 18 + ip)):
        assert pcap.segment(pcap.network(data, link))[3] == PORT
    assert pcap.segment(b"") is None and pcap.segment(b"\x45" + b"\0" * 30) is None


def test_half_stream_stops_at_a_gap_and_wraps():
    h = pcap.Half()
    h.take((1 << 32) - 2, b"", 1.0, True)
    for seq, data in (((1 << 32) - 1, b"ab"), (1, b"cd"), (4, b"zz"), (1, b"XX"), (0, b"overlap")):
        h.take(seq, data, 2.0, False)
    assert h.stream() == b"abcd" and h.clock()(3) == 2.0


@pytest.mark.parametrize("declared,sent,close,truncated", [(5, b"hello", "FIN", False), (5, b"", "RST", True), (10, b"abc", "RST", True)])
def test_truncation(spark, tmp_path, declared, sent, close, truncated):
    head = f"POST /x HTTP/1.1\r\nContent-Length: {declared}\r\n\r\n".encode()
    p = [packet(True, 1000, pcap.SYN), packet(True, 1001, pcap.ACK, head), packet(True, 1001 + len(head), pcap.ACK | (pcap.FIN if close == "FIN" else pcap.RST), sent)]
    path = capture(tmp_path / "t.pcap", p)
    (r,) = pcap.truncation(pcap.packets_of(spark, [path], PORT), PORT).collect()
    assert (r.src, r.method, r.path, r.declared, r.body_seen, r.headers_complete, r.close) == ("10.0.0.2", "POST", "/x", declared, len(sent), True, close)
    report = pcap.truncation_report(spark.createDataFrame([r])).first()
    assert (report.requests, report.truncated, report.verdict) == (1, int(truncated), truncated)


# ---- dumps


def flow(body, answer=None, headers=(), peer="10.1.1.1", method="POST", raw=None, start=10.0, error=None):
    content = raw if raw is not None else json.dumps(body).encode()
    return {
        "request": {"method": method, "host": "node", "path": "/rpc", "headers": [[k.encode(), v.encode()] for k, v in headers], "content": content, "timestamp_start": start, "timestamp_end": start + 0.1},
        "response": None if answer is None else {"status_code": 200, "headers": [], "content": json.dumps(answer).encode(), "timestamp_end": start + 2},
        "client_conn": {"peername": [peer, 5]}, "error": error,
    }


FLOWS = [
    flow(call(1, "getBalance", params=["acct"]), {"id": 1, "result": {"value": 42}}),
    flow(None, {"id": 1, "result": 99}, [("content-encoding", "gzip")], raw=gzip.compress(json.dumps(call(1, "getSlot")).encode())),
    flow([call("a", "getBlock"), call("b", "getBlock")], [{"id": "b", "error": {"code": -32000, "message": "boom"}}, {"id": "a", "result": 1}]),
    flow(call(1, "getHealth"), {"id": 1, "result": "ok"}, peer="192.168.1.3"),
    flow(call(1), {"id": 1}, method="GET"),
]


def dump(path, flows, compress=False):
    data = b"".join(map(mitm.dump, flows))
    path.write_bytes(zstandard.compress(data) if compress else data)
    return str(path)


def key(r):
    return (r.method, r.rpc_id, r.position)


def test_dump_to_calls(spark, tmp_path):
    path = dump(tmp_path / "d.mitm", FLOWS)
    got = sorted(mitm.convert(spark, path).collect(), key=key)
    assert [c for c, _ in CALLS_COLUMNS] == list(got[0].__fields__)
    assert [(r.flow_id, r.method, r.result_json, r.error_code, r.error_message) for r in got] == [(1, "getBalance", '{"value":42}', None, None), (3, "getBlock", "1", None, None), (3, "getBlock", None, -32000, "boom"), (4, "getHealth", '"ok"', None, None), (2, "getSlot", "99", None, None)]
    assert got[0].params_json == '["acct"]' and got[0].duration_ms == pytest.approx(2000)
    assert mitm.convert(spark, path, banned=("192.168.1.3",)).count() == 4
    # the same by one task as by four, and compressed, by name or by content
    for n in (1, 4):
        assert sorted(mitm.convert(spark, path, partitions=n).collect(), key=key) == got
    for name in ("d.mitm.zst", "e.mitm"):
        assert sorted(mitm.convert(spark, dump(tmp_path / name, FLOWS, True)).collect(), key=key) == got
    out = str(tmp_path / "calls")
    mitm.write_calls(mitm.convert(spark, path), out)
    assert spark.read.parquet(out).count() == 5


def test_health(spark, tmp_path):
    missing = [("content-length", "66"), ("user-agent", "bot/1 x")]
    flows = [*FLOWS[:4], *[flow(None, None, missing, raw=b"")] * 3, flow(None, {"id": 1}, missing, raw=b"")]
    classes = mitm.classified(mitm.flow_facts(spark, dump(tmp_path / "h.mitm", flows)))
    r = mitm.health(classes).first()
    assert (r.delivered, r.aborted, r.capture_gap, r.verdict) == (4, 3, 1, False)
    assert {x.user_agent: x.flows for x in mitm.health_by(classes, "user_agent").collect()} == {"<none>": 4, "bot/1": 4}
    assert [x.hour for x in mitm.health_by(classes, "hour").collect()] == [0]


def test_rows_of_odd_bodies():
    def build(q, a="null"):
        return [dict(zip([c for c, _ in CALLS_COLUMNS], r, strict=True)) for r in rows.build_rows(1, q, a, start=0.0, end=5.0, status=None, host=None, path=None)]

    assert build("no json") == build("[1, 2]") == build('"x"') == []
    (r,) = build('{"method": null, "id": 5, "params": {"b": 1, "a": "é"}}', "broken")
    assert (r["method"], r["params_json"], r["result_json"], r["ts_start"], r["duration_ms"]) == ("None", '{"b":1,"a":"\\u00e9"}', None, None, None)
    (r,) = build('{"id": 1}', '{"id": 2, "result": 3, "error": "x"}')  # by position, though the id is another's
    assert (r["method"], r["result_json"], r["error_code"]) == ("?", "3", None)
    assert build('{"id": [1], "method": "m"}', '{"id": [1], "result": 1}')[0]["result_json"] == "1"
    for code, want in (('"-32000"', -32000), ("3.9", 3), ("true", 1), ('"x"', None), ("null", None)):
        assert build('{"id": 1}', f'{{"id": 1, "error": {{"code": {code}}}}}')[0]["error_code"] == want
    assert build('{"id": 1}', '[{"id": 1, "result": 1}, {"id": 1, "result": 2}]')[0]["result_json"] == "2"
    assert rows.decoded(b"\x1f\x8bbroken") == "" and rows.decoded(gzip.compress(b"x")) == "x" and rows.decoded(b"\xff") == "�"
    assert rows.client_address({"x-forwarded-for": " , a"}, "p") == "" and rows.client_address({"x-real-ip": " r "}, "p") == "r" and rows.client_address({}, "p") == "p"


def test_tnetstrings_round_trip():
    value = {"a": [1, -2, 1.5, True, None, b"\x00x", "é"], "b": {}}
    assert mitm.parse(mitm.dump(value)) == value
    assert list(mitm.frames(io.BytesIO(mitm.dump(1) + mitm.dump("x") + b"99:cut"))) == [mitm.dump(1), mitm.dump("x")]
