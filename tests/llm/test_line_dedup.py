import random

from callgrain.llm import line_dedup as m


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def brute(rows, least):
    """doc_id to the lines that stay; rows in order of doc_id."""
    seen, out = [], {}
    for doc, text in rows:
        keep = []
        for line in text.split("\n"):
            x = m.normal(line)
            if len(x) < least:
                keep.append(line)
                continue
            if not any(abs(len(x) - len(y)) < 2 and distance(x, y) < 2 for y in seen):
                keep.append(line)
            seen.append(x)
        out[doc] = "\n".join(keep)
    return out


def edited(r, s):
    for _ in range(r.choice([0, 1, 1, 2])):
        p = r.randrange(len(s))
        s = r.choice([s[:p] + s[p + 1 :], s[:p] + r.choice("abé😀") + s[p:], s[:p] + r.choice("abé") + s[p + 1 :]])
    return s


def test_against_brute_force(spark):
    r = random.Random(11)
    bases = ["".join(r.choice("abcdé ") for _ in range(r.choice([18, 20, 21, 33, 64, 150]))).strip("  ") + "x" for _ in range(14)]
    rows = [(i, "\n".join(edited(r, r.choice(bases)) if r.random() < 0.8 else "Short." for _ in range(r.randint(1, 6)))) for i in range(60)]
    rows += [(60, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (61, " AAAA" * 9 + "\n" + "aaaa  " * 9), (62, "x" * 1500), (63, "x" * 1501)]
    df = spark.createDataFrame([(d, t, "keep", 9) for d, t in rows], "doc_id long, text string, rk string, n_lines int").repartition(3)
    got = {x.doc_id: x for x in m.line_dedup(df).collect()}
    want = brute(rows, 20)
    assert {d: x.text for d, x in got.items()} == want
    assert all(x.rk == "keep" and x.n_dropped == x.n_lines - (want[d].count("\n") + 1 if x.n_dropped < x.n_lines else 0) for d, x in got.items())


def test_nulls_repeats_and_empty(spark):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (None, None), (2, ""), (2, line + "\nown")], "doc_id long, text string")
    got = sorted(((str(x.doc_id), x.text, x.n_dropped) for x in m.line_dedup(df).collect()), key=str)
    assert got == sorted([("1", line, 0), ("1", line, 0), ("None", "", 1), ("None", None, 0), ("2", "", 0), ("2", "own", 1)], key=str)
    assert m.line_dedup(df.limit(0)).count() == 0


def test_one_edit():
    assert m.one_edit("abc", "abc") and m.one_edit("abc", "abd") and m.one_edit("abc", "ab") and m.one_edit("bc", "abc")
    assert not m.one_edit("abc", "acb") and not m.one_edit("abcd", "ab") and m.one_edit("", "a")
