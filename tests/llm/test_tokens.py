import random
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from callgrain.llm.packing import pack
from callgrain.llm.pretokens import UNSAFE, ByteLevel, WordEnds
from callgrain.llm.token_counts import token_counts

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts(seed=3, n=150):
    r = random.Random(seed)
    pool = ["the", " The", "don't", "I'LL", "'s", "x'", "\n", "\n\n ", "  ", "\t", "éÀ", "naïve", "ΣΑΣ", "İstanbul", "日本語", "ß", "123", "4.5", "<|endoftext|>", "<|startoftext|>", "<|endof", "###", "@@!", " ", "é", "Ᲊ", "힣", "😀", "kı", "\r\n", "\x00", "ﬁ", "कि", " "]
    return ["".join(r.choice(pool) + r.choice(["", " ", "", "  "]) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", "a" * 30000, "word " * 9000]


def test_safe_ranges_agree_with_the_library():
    pre, normal = ByteLevel(BYTES), Tokenizer.from_file(WORDS).normalizer
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if UNSAFE.match(c) or 0xD800 <= cp < 0xE000:
            continue
        for probe in (f"x{c}x", f"0{c}0", f"#{c}#", f" {c}"):
            assert pre.pre_tokens(probe) == [probe[a:b] for _, (a, b) in pre.tokenizer.pre_tokenizer.pre_tokenize_str(probe)], hex(cp)
        ours = unicodedata.normalize("NFC", f"a{c}b").replace("Σ", "σ").lower()
        theirs = normal.normalize_str(f"a{c}b")
        assert ours == theirs or (ours[1:-1].isspace() and theirs[1:-1] == " "), hex(cp)


def test_counts(spark):
    own = texts()
    rows = [*enumerate(own), (1000, None), (None, "hello there"), (5, own[5])]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    t = Tokenizer.from_file(BYTES)
    want = sorted((str(d), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(df, BYTES).collect()) == want
    assert token_counts(df.limit(0), BYTES).count() == 0


def test_ids():
    t, own = Tokenizer.from_file(WORDS), texts(4)
    for x, ids in zip(own, WordEnds(WORDS).encoded(own), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_an_exact_round_trip(spark, capacity):
    own = texts(5, 400)
    rows = [*enumerate(own), (1000, None), (None, "hello there")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string").repartition(2)
    got = pack(df, WORDS, capacity).collect()
    t = Tokenizer.from_file(WORDS)
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        pieces = sorted((r.start, r.length, bytes(r.ids)) for r in got if r.doc_id == d)
        assert b"".join(p[2] for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) for r in got if r.doc_id == d)
    sums = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sums.get(r.sequence_id, 0)
        sums[r.sequence_id] = r.offset + r.length
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sums.values())
    assert zlib.crc32(b"") == 0
    assert pack(df.limit(0), WORDS).count() == 0
