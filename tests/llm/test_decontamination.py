import random

from callgrain.llm import decontamination as m

ITEM = "A farmer has 12 cows and sells 5 of them to Maria for 30 kg of corn. How many cows does the farmer keep if Maria returns 2 cows to the yard next spring?"
OTHER = "the quick wolf runs over some lazy dogs while nobody in the small village ever looks out of any window at night"


def run(text, items=((1, ITEM), (2, OTHER)), **more):
    return [(i, other) for _, i, _, other, *_ in m.matches([text.encode()], m.Benchmark(list(items), 8, 5), more.get("share", 0.5))]


def test_copies_and_other_slots():
    assert run(f"Before it. {ITEM} And after.") == [(1, False)]
    assert run(ITEM.upper()) == run(ITEM.lower()) == run(f"So: {ITEM.title()}") == [(1, False)]
    changed = ITEM.replace("12", "40").replace("Maria", "Joseph").replace("30 kg", "7 lbs").replace(" 5 ", " 9 ")
    assert run(changed) == [(1, True)]
    assert run(ITEM.replace("Maria returns", "Peter returns")) == [(1, False)]  # a copy but for one word: most windows stand as they are
    for several in ("Ana Lucia", "Ana Lucia Gomez"):  # a name of other length
        assert run(changed.replace("Joseph", several)) == [(1, True)]
    assert run(OTHER.replace(" ", "\n")) == [(2, False)]
    assert run(OTHER[:40]) == [] and run("") == []
    assert run(OTHER[: len(OTHER) * 3 // 4]) == [(2, False)]


def test_where_it_stands():
    text = "é " * 50 + OTHER + " end"
    (_, item, share, other, a, b), = m.matches([text.encode()], m.Benchmark([(2, OTHER)], 8, 5), 0.5)
    assert (item, share, other, text.encode()[a:b].decode()) == (2, 1.0, False, OTHER)


def test_against_plain_comparison_in_blocks(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(6, 40)))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        body = [" ".join(r.choice(words) for _ in range(r.randint(0, 30)))]
        if d % 3 == 0:
            t = r.choice(items[:12])[1].split()
            body.append(" ".join(t[: r.randint(len(t) // 3, len(t))]))
            body.append(" ".join(r.choice(words) for _ in range(10)))
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (0, docs[0][1])]

    def grams(t):
        w = (t or "").split()
        return [tuple(w[i : i + 8]) for i in range(len(w) - 7)]

    def short(t):
        return f" {' '.join((t or '').split())} "

    want = sorted(str((d, i)) for d, t in docs for i, x in items if (short(x).strip() and not grams(x) and short(x) in short(t)) or (g := grams(x)) and sum(y in set(grams(t)) for y in g) >= 0.5 * len(g))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, item_id string, share string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (20_000_000, 300):
        got = m.contaminated(df, bench, most_chars=most)
        assert sorted(str((x.doc_id, x.item_id)) for x in got.collect()) == want
        left = m.decontaminate(df, bench, most_chars=most)
        assert left.columns == df.columns and left.count() == len(docs) - len({x[1:].split(",")[0] for x in want}) - ("(0," in " ".join(want))
    assert m.contaminated(df.limit(0), bench).count() == 0 and m.contaminated(df, bench.limit(0)).count() == 0
    assert m.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_items_without_a_window_match_as_a_whole():
    short, dense, named, odd = "Who wrote the first Latin grammar?", "Add 12 34 56 kg Ann 7 8 9 to 3 4 5", "The 7 cats 5 Ann saw 5 dogs 9 and 9 cows 8 by 4", "?!"
    items = [(1, short), (2, dense), (3, named), (4, odd), (5, None)]
    for i, t in ((1, short), (2, dense), (3, named)):
        assert run(f"Some words before it, {t} And after.", items) == [(i, False)]
        assert run(t, items) == run(t.upper(), items) == run(t + " " + t, items) == [(i, False)]
    assert run("Who wrote the second Latin grammar?", items) == run("Who wrote the first Latin", items) == run("?!", items) == []
    assert run(dense.replace("34", "35"), items) == []  # too few literal words for other slots
    assert run(named.replace("Ann", "Eve").replace("5", "6"), items) == [(3, True)]
    assert run(named.replace("7", "5"), items) == []  # one value of the text for two of the item
    texts, bench = [b"Who wrote the first", b"Latin grammar?", b"", short.encode()], m.Benchmark(items, 8, 5)
    assert [x[:2] for x in m.matches(texts, bench, 0.5)] == [(3, 1)]  # never across two texts
    (_, _, share, _, a, b), = m.matches([f"\u00e9 {short} x".encode()], bench, 0.5)
    assert share == 1.0 and f"\u00e9 {short} x".encode()[a:b].decode() == short[:-1]


def test_a_long_passage_of_a_longer_item():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    item = [(1, " ".join(words))]
    assert run("before it " + " ".join(words[100:150]) + " after it", item) == [(1, False)]
    assert run(" ".join(words[100:149]), item) == []
    assert run(" ".join(words[100:149] + ["x"] + words[150:170]), item) == []  # not on end


def test_one_changed_slot_takes_only_its_windows():
    long = ITEM + " The rest of the herd stays behind on the hill until the snow has gone and the grass is green again in the valley below the old mill."
    items = [(1, long)]
    assert run(long.replace("Maria returns", "Peter returns"), items) == [(1, False)]  # two for one: the windows of both don't count
    assert run(long.replace("12", "5"), items) == [(1, False)]  # one for two
    (_, _, share, other, _, _), = m.matches([long.replace("12", "40").replace("Maria returns", "Peter returns").encode()], m.Benchmark(items, 8, 5), 0.5)
    assert other and 0.5 < share < 1
    thrice = "Then Maria " + "keeps all of the corn she has in a big dry barn near town while Maria " * 2 + "sleeps at home in her own warm bed"
    many = m.matches([thrice.replace("while Maria sleeps", "while Peter sleeps").encode()], m.Benchmark([(1, thrice)], 8, 5), 0.5)
    assert many[0][2] > 0.7  # only the windows of the rarer partner go
