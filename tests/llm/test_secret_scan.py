import re

from callgrain.llm import secret_scan as m

HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "A1B2C3D4E5F6"
TEXTS = [
    None, "", f"é😀 password = 'hunter2hunter2' and {KEY}", f"token=secret:abcdefghij {HEX}", "Api_Key: short", f"SECRET\"={HEX}x TOKEN==abcdefgh",
    "AKIAshort AKIAABC", f"{HEX}g{HEX[:31]} {HEX}ff", "passwd:abc passwd:abcdefgh", "toKen=abcdefghij", f"password : {KEY}{KEY}", "-----BEGIN RSA PRIVATE KEY-----",
    ("x" * 5000 + "secret=aaaaaaaaa ") * 40, "tokenſ=abcdefghij", "apikey='a.b/c+d_e=f-g'",
]


def brute(text):
    out = []
    for rank, (kind, pattern, ok) in enumerate((
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda x: len(x[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda x: len(x[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda x: len(x[0]) >= 32),
    )):
        out += [(x.start(), rank, x.end(), kind) for x in re.finditer(pattern, text or "") if ok(x)]
    return sorted(out)


def rows(df):
    return {(r.path, r.version): [tuple(s) for s in r.spans] for r in df.collect()}


def test_against_brute_force_with_copies(spark):
    data = [(i, v, t, "x") for i, t in enumerate(TEXTS) for v in (1, 2)]
    df = spark.createDataFrame(data, "path long, version int, content string, blob string").repartition(3)
    found, added = m.scan_history(df, rules=m.BASE)
    assert rows(found) == {(i, v): brute(t) for i, v, t, _ in data}
    assert added.count() == 3 * len({t or "" for t in TEXTS})
    assert m.scan_history(df.limit(0))[0].count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    df = spark.createDataFrame([("a", 1, TEXTS[2]), ("a", 2, TEXTS[3]), ("b", 1, TEXTS[2])], "path string, version int, content string")
    _, first = m.scan_history(df.where("version = 1"), rules=m.BASE)
    ledger = spark.createDataFrame(first.collect(), first.schema)
    found, added = m.scan_history(df, ledger, m.BASE)
    assert {bytes(r.blob) for r in added.collect()} == {bytes(r.blob) for r in found.where("version = 2").collect()}
    assert rows(found) == rows(m.scan_history(df, rules=m.BASE)[0])
    newer = (*m.BASE[:2], m.Rule("hex", "[0-9a-f]{30,}", version=2))
    found, added = m.scan_history(df, ledger.unionByName(added), newer)
    assert {(r.kind, r.rule_version) for r in added.collect()} == {("hex", 2)}
    assert rows(found) == rows(m.scan_history(df, rules=newer)[0])


def test_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(None, 1, TEXTS[2]), (None, 1, TEXTS[2]), (4, None, TEXTS[2])], "path long, version int, content string")
    found = m.scan_history(df, rules=m.BASE)[0].collect()
    assert len(found) == 3 and all([tuple(s) for s in r.spans] == brute(TEXTS[2]) for r in found)
