import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as c  # noqa: E402

from callgrain.llm import decontamination as d  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_ngram_join import brute as brute_groups  # noqa: E402

EN = "the of and to in that it was for on with as his they be at one have this from or had by word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    r = random.Random(8)
    rows = []
    for i in range(60):
        words = EN if i % 3 else DE
        rows.append([i, "\n".join(sentence(r, words, r.randint(12, 30)) for _ in range(r.randint(1, 5))), "en" if i % 3 else "de"])
    item = sentence(r, EN, 30)
    rows[20][1] += "\n" + item
    rows[7][1] = sentence(r, EN, 120)
    rows.append([60, rows[4][1], "en"])  # exact copy
    near = rows[7][1].split()
    near[3] = "changed"
    rows.append([61, " ".join(near), "en"])  # near copy on one line
    rows.append([62, rows[5][1].split("\n")[0].replace("e", "é", 1) + "\n" + sentence(r, EN, 15), "en"])
    rows += [[63, "12345 !!! 678", "en"], [64, None, None], [65, "", "de"], [66, sentence(r, EN, 6000), "en"], [67, sentence(r, DE, 40), None]]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, item


def test_run_against_brute_force(spark, corpus):
    where, rows, item = corpus
    got = c.run(spark, where).collect()
    docs = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    cleaned = brute_lines(docs, 20)
    docs = [(i, cleaned[i]) for i, t in docs if cleaned[i].strip() or cleaned[i] == t]
    docs = [(i, t) for i, t in docs if (i, i) in {(x[0], x[2]) for x in brute_groups(docs, 5, 80)}]
    docs = [(i, t) for i, t in docs if item not in t]
    assert 60 not in dict(docs) and 61 not in dict(docs) and 20 not in dict(docs) and 62 in dict(docs)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in docs}
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in want.items()}
    import zlib

    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_stages_on_empty_tables_keep_the_columns(spark, corpus):
    where, *_ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == c.COLUMNS and out.count() == 0, name
    assert c.packing(spark, docs, where).count() == 0


def test_decontamination_rule_is_the_operators(corpus):
    _, rows, item = corpus
    bench = d.Benchmark([(1, item)], 8, 5)
    assert [t for t, *_ in d.matches([(t or "").encode() for _, t, _ in rows], bench, 0.5)] == [20]
