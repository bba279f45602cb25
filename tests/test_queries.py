import json
import math

import pytest
from pyspark.sql import functions as F

from callgrain.functions import exprs as x
from callgrain.operators import monitoring as mo, replay as rp, traffic as t
from callgrain.plans import registry
from callgrain.schema import CALLS_SCHEMA
from callgrain.sources import series


def index(rule, n, q):
    at = (n - 1) * q
    return {"nearest": math.floor(at + 0.5), "lower": math.floor(at), "half_even": min(n - 1, round(at)), "floor_np": min(n - 1, int(n * q))}[rule]


def ranked(rule, held, q):
    if rule != "linear":
        return held[index(rule, len(held), q)]
    at = (len(held) - 1) * q
    lo = math.floor(at)
    return held[lo] + (held[min(lo + 1, len(held) - 1)] - held[lo]) * (at - lo)


@pytest.mark.parametrize("rule", ["nearest", "lower", "half_even", "floor_np", "linear"])
def test_index_quantiles(spark, monkeypatch, rule):
    monkeypatch.setattr(x, "FINE", 3)
    groups = {"signs": [-3.0, -0.5, 0.0, 0.25, 1e9, 7.0], "tail": [1e-3 * i for i in range(1, 200)] + [1e7], "one": [5.0], "two": [2.0, 9.0], "same": [3.0] * 9, "squares": [float(i * i) for i in range(1, 11)], "many": [((i * 7919) % 1000) / 8 for i in range(500)], "none": [None, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    q = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in x.with_quantiles(df, ["k"], "v", rule, q, {"n": "rows", "max": "max", "mean": "mean"}).collect()}
    for k, vs in groups.items():
        held = sorted(v for v in vs if v is not None)
        for name, share in q.items():
            assert got[k][name] == (pytest.approx(ranked(rule, held, share)) if held else None), (k, name)
        assert (got[k].max, got[k].mean) == ((max(held), pytest.approx(sum(held) / len(held))) if held else (None, None))
        assert got[k].n == sum(1 for name, _ in rows if name == k)
    whole = sorted(v for _, v in rows if v is not None)
    (r,) = x.with_quantiles(df, [], "v", rule, q, {"n": "rows"}).collect()
    assert [r[n] for n in q] == pytest.approx([ranked(rule, whole, s) for s in q.values()]) and r.n == len(rows)
    (r,) = x.with_quantiles(df.limit(0), [], "v", rule, q, {"n": "rows", "max": "max"}).collect()
    assert (r.n, r.max, r.p50) == (0, None, None)


def test_buckets_and_names(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 10, 11, 50, 51, 99, 100, 101)], "n int")
    got = df.select(x.size_bucket(F.col("n")), x.replay_bucket(F.col("n"))).collect()
    assert [r[0] for r in got] == ["1", "2-10", "2-10", "11-50", "11-50", "51-99", "51-99", "100+", "100+"]
    assert [r[1] for r in got] == ["1", "2-10", "2-10", "11-50", "11-50", "51-100", "51-100", "51-100", "100+"]
    names = spark.createDataFrame([(m,) for m in ("eth_call", "Filecoin.X", "filecoin.X", "F3.a", "web3_", "zz")], "m string").select(x.namespace(F.col("m"))).collect()
    assert [r[0] for r in names] == ["eth", "Filecoin", "other", "F3", "web3", "other"]
    change = spark.createDataFrame([(0.0, 5.0), (10.0, 15.0), (None, 1.0)], "a double, b double").select(x.pct_change(F.col("a"), F.col("b")), x.pct_change_or_zero(F.col("a"), F.col("b")), x.verdict_lower_better(x.pct_change_or_zero(F.col("a"), F.col("b")))).collect()
    assert [tuple(r)[:2] for r in change] == [(None, 0.0), (50.0, 50.0), (None, None)] and change[1][2] == "worse"
    label = spark.createDataFrame([(None,), ("",), ("x" * 200,)], "p string").select(x.params_label(F.col("p"))).collect()
    assert [r[0] for r in label] == ["<no params>", "<no params>", "x" * 177 + "..."]
    assert [r[0] for r in spark.createDataFrame([(5,), (1234,), (123456,), (2500000,), (2500000000,)], "v long").select(x.human(F.col("v"))).collect()] == ["5", "1.2k", "123k", "2.5M", "2500M"]
    labels = spark.createDataFrame([(95438.0, 9.5, 1536.0), (999.0, 10.2, 5.0)], "n double, d double, b double").select(x.human_calls(F.col("n")), x.ms_label(F.col("d")), x.binary_label(F.col("b"))).collect()
    assert [tuple(r) for r in labels] == [("95.4k", "9.5 ms", "1.5KB"), ("999", "10 ms", "5.0B")]
    gaps = spark.createDataFrame([(10.0, 8.0, False), (10.0, 2010.0, False), (10.0, 10.1, True)], "a double, b double, t boolean").select(x.delta_label(F.col("a"), F.col("b"), F.col("t"))).collect()
    assert [r[0] for r in gaps] == ["2.00 ms faster", "2.00 s slower", "≈ equivalent (0.10 ms)"]


def calls(spark, rows):
    names = [f.name for f in CALLS_SCHEMA]
    return spark.createDataFrame([tuple({"position": 0, "batch_size": 1, "method": "m"}.get(n) if n not in r else r[n] for n in names) for r in rows], CALLS_SCHEMA)


def test_empty_and_null_calls(spark):
    none = calls(spark, [])
    for f in (t.singleton_per_method, t.batch_flows, t.errors_by_method, t.slow_flows, rp.methods, rp.error_codes, rp.status_errors, rp.slowest_flows, t.popular_params, rp.errors_by_method):
        assert f(none).count() == 0
    assert t.headline(none).first().req_per_s is None
    got = t.compare_reweighted(none, none).collect()
    assert len(got) == 4 and all(math.isnan(v) for r in got for v in r[2:])
    lost = calls(spark, [{"flow_id": 1, "http_status": None}, {"flow_id": 2, "http_status": 200, "duration_ms": 4.0, "result_json": "null", "error_code": 3}])
    (r,) = t.summary_counts(lost).collect()
    assert (r.no_response, r.success, r.errors, r.no_answer) == (1, 1, 1, 0)


def test_errors_health_and_curve_by_hand(spark):
    rows = [{"flow_id": i, "method": "a" if i < 6 else "b", "error_code": 1 if i == 0 else None, "duration_ms": float(i)} for i in range(9)]
    got = [tuple(r) for r in t.errors_by_method(calls(spark, rows)).collect()]
    assert got == [("a", 6, 1, 16.67), ("b", 3, 0, 0.0)]  # those called most first, also without an error
    from callgrain.operators import chartdata as ch
    from callgrain.sources import mitm

    facts = spark.createDataFrame([(i, c) for i, c in enumerate(["delivered"] * 6 + ["aborted"] * 3 + ["capture_gap"] + ["empty_ok"] * 90)], "flow_id long, class string").withColumn("upstream", F.lit(False))
    r = mitm.health(facts).first()
    assert (r.delivered_pct, r.gap_pct, r.verdict) == (60.0, 1.0, False)  # of the flows that bear a body; a share that equals the limit warns
    assert mitm.health(facts.limit(0)).first().delivered_pct == 0.0
    points = ch.CDF_POINTS
    assert len(points) == 100 and points[0] == 0.01 and points[79] == 0.98 and points[80] == 0.981 and points[99] == 0.999
    curve = ch.cdf(calls(spark, rows), calls(spark, rows[:5])).collect()
    assert len(curve) == 200 and max(r.duration_ms for r in curve if r.phase == "before") == pytest.approx(8 * 0.999)
    marks = {(r.phase, r.q): (r.duration_ms, r.label) for r in ch.cdf_marks(calls(spark, rows), calls(spark, rows[:5])).collect()}
    assert marks["before", 0.5] == (4.0, "median 4.0 ms") and marks["after", 0.95] == (pytest.approx(3.8), "p95 3.8 ms")
    assert set(ch.charts(calls(spark, rows), calls(spark, rows[:5]))) >= {"overall", "cdf", "scorecard", "error_kinds"}


def test_replay_latency_and_body_sizes_overall(spark):
    rows = [{"flow_id": i, "duration_ms": float(i) if i < 4 else None, "flow_req_bytes": 10 * i, "flow_resp_bytes": i if i % 2 else None} for i in range(5)]
    (r,) = rp.latency_overall(calls(spark, rows)).collect()
    assert (r.bucket, r.flows, r.max, r.p50, r.p95, r.p99) == ("overall", 4, 3.0, 2.0, 3.0, 3.0)
    got = {r.body: (r.flows, r.max, r.total, r.p50, r.p95) for r in rp.body_sizes(calls(spark, rows)).collect()}
    assert got == {"request": (5, 40.0, 100.0, 20.0, 40.0), "response": (2, 3.0, 4.0, 3.0, 3.0)}
    assert rp.latency_overall(calls(spark, [])).count() == rp.body_sizes(calls(spark, [])).count() == 0


def test_identity(spark):
    def label(method, result, **more):
        return t.node_identity(calls(spark, [{"flow_id": 1, "method": method, "result_json": result, "ts_start": 1716700000.0}]), **more).first()

    r = label("Filecoin.Version", '{"Agent":"forest","Version":"0.25.0+git.abcdef0123+x"}')
    assert (r.agent, r.version, r.commit, r.label) == ("Forest", "v0.25.0", "abcdef0123", "Forest: 2024-05-26-abcdef0")
    assert label("web3_clientVersion", '"lotus/1.36.1-dev+git.123"').label == "Lotus: v1.36.1-dev"
    assert label("web3_clientVersion", '"lotus/1.36.1"', lotus_version="1.40.0").label == "Lotus: 1.40.0"
    assert label("web3_clientVersion", '"v1.2.3"').label == "Node: v1.2.3"
    assert label("other", "1").label == "Node: unknown"


def test_pairing_against_the_greedy_pointer(spark):
    import random

    r, req, resp, want = random.Random(4), [], [], {}
    for c in range(60):
        a, b = (sorted(r.randint(0, 30) for _ in range(r.randint(0, 12))) for _ in range(2))
        req += [(c, i, float(v)) for i, v in enumerate(a)]
        resp += [(c, k, float(v)) for k, v in enumerate(b)]
        k = 0
        for i, v in enumerate(a):
            while k < len(b) and b[k] < v:
                k += 1
            want[c, i] = k if k < len(b) else None
            k += 1
    got = rp.pair_responses(spark.createDataFrame(req, "conn long, i long, ts double"), spark.createDataFrame(resp, "conn long, k long, ts double"))
    assert {(x.conn, x.i): x.k for x in got.collect()} == want


def test_monitoring_files(spark, tmp_path):
    def write(name, result):
        (tmp_path / name).write_text(json.dumps({"data": {"result": result}}))

    gib = 1 << 30
    write("w1__memory_total.json", [{"metric": {}, "values": [[t_, str(8 * gib)] for t_ in (0, 60, 120)]}, {"metric": {}, "values": [[0, "1"]]}])
    write("w1__memory_available.json", [{"metric": {}, "values": [[0, str(6 * gib)], [60, str(2 * gib)], [60, str(4 * gib)], [999, "5"]]}])
    idle, user = [0, 50, 40, 90, 140], [0, 10, 20, 30, 40]
    write("w1__cpu.json", [{"metric": {"mode": "idle"}, "values": [[i * 60, str(v)] for i, v in enumerate(idle)]}, {"metric": {"mode": "user"}, "values": [[i * 60, str(v)] for i, v in enumerate(user) if i != 3]}])
    write("may22__memory_total.json", [])
    p = series.points(spark, str(tmp_path))
    assert [r.window for r in series.windows(p).collect()] == ["w1"]
    r = mo.mem_stats(p).first()
    assert (r.used_min, r.used_max, r.total, r.n, r.pct_max) == (2.0, 4.0, 8.0, 2, 50.0)
    steps = {x.t: (round(x.util, 3), round(x.cores, 3)) for x in mo.cpu_steps(p).collect()}
    # 60 to 120 falls; 180 lacks a mode, so 120 to 240 is a step
    assert steps == {30: (round(100 * (1 - 50 / 60), 3), 1.0), 180: (round(100 * (1 - 100 / 120), 3), 1.0)}
    names = spark.createDataFrame([("calls-26-05-26", 0.0), ("calls", 86400.0), ("calls-26-13-26", 86400.0)], "s string, t double").select(series.label_for(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in names] == ["may26", "jan02", "jan02"]
    assert series.capture_window(calls(spark, [{"flow_id": 1, "ts_start": 1000.9}]), 10).first() == (990, 1010)


def test_streams_agree_with_batch(spark, tmp_path):
    from callgrain.streaming import replay as s

    rows = [{"flow_id": i // 2, "position": i % 2, "batch_size": 2, "method": f"m{i % 3}", "duration_ms": float((i // 2) * 37 % 50), "error_code": 1 if i % 5 == 0 else None, "ts_start": 1000.0 * i} for i in range(60)]
    df = calls(spark, rows)
    folder = str(tmp_path / "in")
    for part in ("flow_id < 12", "flow_id >= 12"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
        q = s.slowest_flows(s.calls_stream(spark, folder), str(tmp_path / "top"), str(tmp_path / "c0"), k=5)
        q.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "top" / "1")).orderBy(F.desc("duration_ms"), "flow_id").select("flow_id").collect()
    assert kept == df.where("position = 0").orderBy(F.desc("duration_ms"), "flow_id").select("flow_id").limit(5).collect()
    for name, f in (("methods", s.method_counters), ("buckets", s.bucket_counters), ("hours", s.hourly)):
        s.run_to_memory(f(s.calls_stream(spark, folder)), name, str(tmp_path / name)).awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(df).collect()))


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", ["a1_singleton_per_method", "a32_compare_overall", "a39_cpu_stats", "x5_pairing"])
def test_partition_counts_agree(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert run(1) == run(7)
