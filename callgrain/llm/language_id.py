"""Language identification by unigram pieces over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. A word's likelihood is the sum over all its segmentations into pieces, by
the forward algorithm; a text's is the product over its words. Probabilities are learned by expectation maximisation with forward-backward
counts on a sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .base import WINDOW, resting, schema, staged, text_chunks

#: Words up to this length are scored many at a time and remembered; longer ones alone, piece by piece with the same sums.
LONGEST, REMEMBERED = 24, 300_000
#: Characters of a long word whose pieces are looked up at a time.
STRETCH = 8192
LETTER = regex.compile(r"\p{L}")
UNSEEN = 1e-7


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the vocabulary's strings, their index, and the longest string. Letters' case is folded; every other symbol is one unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sorted({p.lower() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(p := model.id_to_piece(i)) <= 16})
    hashes = np.array([_rolled(np.array([list(map(ord, w))], np.uint64))[0, 0, -1] for w in found], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order, max(map(len, found))


def _rolled(chars: np.ndarray) -> np.ndarray:
    """chars[w, i] to hashes[w, 0, j] of the prefix that ends with j."""
    h, out = np.full(len(chars), 0x9E3779B97F4A7C15, np.uint64), []
    with np.errstate(over="ignore"):
        for j in range(chars.shape[1]):
            h = (h ^ chars[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
            h = h ^ (h >> np.uint64(29))
            out.append(h)
    return np.stack(out, axis=1)[:, None, :]


def lattice(words: list[str], path: str) -> np.ndarray:
    """For words of one length the piece at [word, start, length - 1]: an index, -1 for none. A character that is no piece is piece len(vocabulary)."""
    hashes, order, longest = pieces(path)
    n = len(words[0])
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
    out = np.full((len(words), n, min(n, longest)), -1, np.int32)
    for start in range(n):
        h = _rolled(chars[:, start : start + longest])[:, 0, :]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        out[:, start, : h.shape[1]] = np.where(hashes[at] == h, order[at], -1)
    first = out[:, :, 0]
    first[first < 0] = len(hashes)
    return out


def forward(lat: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Likelihoods [word, position, language] of all prefixes; prob is [piece, language]."""
    n = lat.shape[1]
    alpha = np.zeros((len(lat), n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(end, lat.shape[2]) + 1):
            p = lat[:, end - size, size - 1]
            if size == 1:
                alpha[:, end] += alpha[:, end - 1] * prob[p]
            elif len(rows := np.flatnonzero(p >= 0)):
                alpha[rows, end] += alpha[rows, end - size] * prob[p[rows]]
    return alpha


def backward(lat: np.ndarray, prob: np.ndarray) -> np.ndarray:
    n = lat.shape[1]
    beta = np.zeros((len(lat), n + 1, prob.shape[1]))
    beta[:, n] = 1
    for start in range(n - 1, -1, -1):
        for size in range(1, min(n - start, lat.shape[2]) + 1):
            p = lat[:, start, size - 1]
            rows = np.flatnonzero(p >= 0)
            beta[rows, start] += prob[p[rows]] * beta[rows, start + size]
    return beta


def endings(word: str, path: str) -> Iterator[np.ndarray]:
    """For stretches of a word the pieces [place, length - 1] that end with each place, as lattice() has them by their start: all starts of a
    stretch are looked up at once."""
    hashes, order, longest = pieces(path)
    for first in range(0, len(word), STRETCH):
        lead = max(0, first - longest + 1)
        chars = np.frombuffer(word[lead : first + STRETCH].encode("utf-32-le"), np.uint32).astype(np.uint64)
        # what goes beyond the stretch has no end in it, so the filling is never read
        h = _rolled(np.lib.stride_tricks.sliding_window_view(np.concatenate([chars, np.zeros(longest - 1, np.uint64)]), longest))[:, 0, :]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        starts = np.where(hashes[at] == h, order[at], -1)
        starts[starts[:, 0] < 0, 0] = len(hashes)
        size = len(starts) - (first - lead)
        out = np.full((size, longest), -1, np.int32)
        for n in range(1, longest + 1):
            # the piece of n characters that ends with place i of the stretch starts n - 1 before it
            at = np.arange(size) + (first - lead) - n + 1
            held = at >= 0
            out[held, n - 1] = starts[at[held], n - 1]
        yield out


def log_sums(word: str, log_prob: np.ndarray, path: str, whole: bool = False) -> np.ndarray:
    """Logarithms of the likelihoods [language] of a word of any length, or of all its prefixes [place, language], without underflow; log_prob
    is [piece, language] with a last row of -inf for no piece. Only as many prefixes as the longest piece are held, unless all are wanted."""
    longest = pieces(path)[2]
    back = np.full((longest, log_prob.shape[1]), -np.inf)  # of the prefixes before a place, the nearest first
    back[0] = 0.0
    held = [back[:1].copy()]
    for ends in endings(word, path):
        terms = log_prob[ends]
        for p in terms:
            now = np.logaddexp.reduce(back + p, axis=0)
            back[1:] = back[:-1].copy()
            back[0] = now
            if whole:
                held.append(back[:1].copy())
    return np.concatenate(held) if whole else back[0]


def with_none(prob: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.concatenate([prob, np.zeros((1, prob.shape[1]))]))


def expected_of_long(word: str, weight: float, prob: np.ndarray, path: str, out: np.ndarray) -> None:
    """Add the expected uses of each piece in a long word; prob [piece, 1]."""
    log_prob = with_none(prob)
    a = log_sums(word, log_prob, path, True)[:, 0]
    ends = np.concatenate(list(endings(word, path)))
    b = np.full(len(word) + 1, -np.inf)
    b[-1] = 0.0
    longest = ends.shape[1]
    for start in range(len(word) - 1, -1, -1):
        n = np.arange(1, min(longest, len(word) - start) + 1)
        b[start] = np.logaddexp.reduce(log_prob[ends[start + n - 1, n - 1], 0] + b[start + n])
    place, n = np.nonzero(ends >= 0)
    p = ends[place, n]
    np.add.at(out, p, weight * np.exp(a[place - n] + log_prob[p, 0] + b[place + 1] - a[-1]))


def split_words(text: str) -> list[str]:
    """Lower-case runs with a word-start mark."""
    return ["▁" + w for w in text.lower().split()]


def _by_length(words: list[str], size: int = 4096) -> Iterator[list[int]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for first in range(0, len(rows), size):
            yield rows[first : first + size].tolist()


def log_likelihoods(words: list[str], prob: np.ndarray, path: str) -> np.ndarray:
    out = np.zeros((len(words), prob.shape[1]))
    log_prob = with_none(prob) if any(len(w) > LONGEST for w in words) else None
    for rows in _by_length(words):
        if len(words[rows[0]]) > LONGEST:
            for i in rows:
                out[i] = log_sums(words[i], log_prob, path)
            continue
        lat = lattice([words[i] for i in rows], path)
        out[rows] = np.log(np.maximum(forward(lat, prob)[:, -1], 1e-300))
    return out


def expected(words: list[str], weights: np.ndarray, prob: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece in the words; prob [piece, 1]."""
    out = np.zeros(len(prob))
    for rows in _by_length(words):
        if len(words[rows[0]]) > LONGEST:
            for i in rows:
                expected_of_long(words[i], weights[i], prob, path, out)
            continue
        lat = lattice([words[i] for i in rows], path)
        a, b = forward(lat, prob)[:, :, 0], backward(lat, prob)[:, :, 0]
        scale = weights[rows] / np.maximum(a[:, -1], 1e-300)
        for start in range(lat.shape[1]):
            for size in range(1, min(lat.shape[1] - start, lat.shape[2]) + 1):
                p = lat[:, start, size - 1]
                at = np.flatnonzero(p >= 0)
                np.add.at(out, p[at], a[at, start] * prob[p[at], 0] * b[at, start + size] * scale[at])
    return out


@resting
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_chunks(batches):
        for lang, text in zip(part["lang"].to_pylist(), texts, strict=True):
            counts = pd.Series(split_words(text.decode("utf-8", "replace"))).value_counts()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "word": pa.array(counts.index.tolist(), pa.string()), "k": pa.array(counts.to_numpy(np.int64))})


def _expectation(probs: dict[str, np.ndarray], path: str):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, rows in frame.groupby("lang"):
                for first in range(0, len(rows), 20_000):
                    part = rows.iloc[first : first + 20_000]
                    x = expected(part["word"].tolist(), part["k"].to_numpy(np.float64), probs[lang][:, None], path)
                    sums[lang] = sums[lang] + x if lang in sums else x
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "piece": pa.array(at.astype(np.int64)), "k": pa.array(x[at])})

    return run


class Model:
    """Languages in order, and [piece, language] probabilities."""

    def __init__(self, langs: list[str], prob: np.ndarray, path: str):
        self.langs, self.prob, self.path = langs, prob, path


def fit(labelled: DataFrame, path: str, per_language: int = 2000, rounds: int = 3) -> Model:
    """Learn from labelled (lang, text, key), lang not null: at most about per_language documents of a language, those with the smallest hashes
    of key, whole and of whatever length. That bound makes the fit cost the same at every input size; counting and choosing runs over all
    rows. The driver gets piece counts only: the vocabulary's size for each language."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("key").alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    span = F.lit(None).cast("boolean")
    for lang in langs:
        # a slice of the hash range that holds about that many documents
        share = min(1.0, per_language / sizes[lang])
        top = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        span = F.when(F.col("lang") == lang, F.col("h") <= F.lit(min(top, 2**63 - 1))).otherwise(span)
    sample = rows.where(span).select("lang", "text")
    counted = sample.mapInArrow(_word_counts, schema("lang string, word string, k long")).groupBy("lang", "word").agg(F.sum("k").alias("k"))
    # few bytes, but the rounds below work long on them: for all cores
    words = staged(counted.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "word"))
    size = len(pieces(path)[0]) + 1
    probs = {lang: np.full(size, 1.0 / size) for lang in langs}
    for _ in range(rounds):
        counts = words.mapInArrow(_expectation(probs, path), schema("lang string, piece long, k double")).groupBy("lang", "piece").agg(F.sum("k").alias("k")).toPandas()
        for lang in langs:
            x = np.zeros(size)
            own = counts[counts["lang"] == lang].sort_values("piece")
            x[own["piece"].to_numpy()] = own["k"].to_numpy()
            probs[lang] = np.round((x + 0.01) / (x.sum() + 0.01 * size), 12)
    return Model(langs, np.maximum(np.stack([probs[x] for x in langs], axis=1), UNSEEN * 1e-3) if langs else np.zeros((size, 0)), path)


def _predicted(model: Model):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.langs)))
        for part, texts in text_chunks(batches, size=2 * WINDOW):
            words = [split_words(t.decode("utf-8", "replace")) for t in texts]
            if len(known) > REMEMBERED or any(len(w) > LONGEST for w in known):
                known, table = {w: i for w, i in known.items() if len(w) <= LONGEST} if len(known) <= REMEMBERED else {}, table if len(known) <= REMEMBERED else table[:0]
            missing = list({w for ws in words for w in ws if w not in known})
            if missing:
                known.update(zip(missing, range(len(table), len(table) + len(missing)), strict=True))
                table = np.concatenate([table, log_likelihoods(missing, model.prob, model.path)])
            lang, score = [], []
            for text, ws in zip(texts, words, strict=True):
                if not model.langs or not LETTER.search(text.decode("utf-8", "replace")):
                    lang.append("und")
                    score.append(0.0)
                    continue
                at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                x = table[at].sum(axis=0, dtype=np.float64)
                p = np.exp(x - x.max())
                lang.append(model.langs[int(np.argmax(p))])
                score.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the share of the best language in the sum of all likelihoods. Only text is read.

    One pass without a shuffle. A null text, or one without a letter: `und` and 0; so it is for all if no language was learned. Repeated
    rows are predicted each; ties go to the first language in order; words of any length are summed whole; an empty table gives no rows. Clashing columns lang_pred and score of
    docs are replaced. Workers remember a bounded number of words; a very long text is scored whole.
    """
    docs = docs.drop("lang_pred", "score")
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predicted(model), out)
