"""Toxicity by weak supervision.

Many lexicon and pattern voters vote on documents, or keep silent: fixed word lists by language, patterns of capitals and marks, and lists of
words and of word beginnings that toxic labels favour. A generative label model, fitted to the votes on all documents, labelled or not,
estimates each voter's accuracy and which voters depend on each other within a class: a forest of the strongest dependences, by expectation
maximisation over vote patterns. A linear classifier is trained on its posteriors, which follow from votes alone, and scores all documents.
Labels choose the learned lists and hold the label model's classes in place: without them its second class drifts to documents of one
language. They are no targets of the classifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import MARKS, WINDOW, folded, joined, mixed, powers, resting, schema, signed, staged, text_chunks, unstage, word_hashes
from .base import _MIX

# Insulting words by language.
INSULTS = {
    "en": "idiot idiots stupid moron morons pathetic worthless disgusting scum trash loser losers clown dumb jerk fool filth filthy garbage vermin hate kill retard bastard bitch shit fuck fucking asshole",
    "de": "dummkopf arschloch idioten scheisse scheiße schwein abschaum widerlich verdammt",
    "fr": "connard salaud imbécile abruti ordure merde pourriture dégoûtant",
    "es": "idiota estúpido imbécil basura asqueroso mierda cabrón pendejo",
}
PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = ("capitals", "shouts", "masked", "stretched")
#: Learned words are dealt into so many lists; learned beginnings have a list for each length.
DEALT = 2
VOTERS = (*(f"insults_{x}" for x in INSULTS), *PATTERNS, *(f"words_{i}" for i in range(DEALT)), *(f"starts_{p}" for p in PREFIXES))
#: A list votes where it has a hit in so many words, and another in each further so many.
WORDS_A_HIT = 100
MASK = np.isin(np.arange(256), np.frombuffer(b"*#@$%", np.uint8))


class Features(NamedTuple):
    """text: of each word; hashes: [word, 1 + prefix], 0 for a prefix that isn't shorter than its word; the rest are counts for each text."""

    text: np.ndarray
    hashes: np.ndarray
    words: np.ndarray
    capitals: np.ndarray
    shouts: np.ndarray
    masked: np.ndarray
    stretched: np.ndarray


@dataclass
class Lexicon:
    """Sorted hashes, with the log-odds and the voter of each."""

    hashes: np.ndarray
    weight: np.ndarray
    voter: np.ndarray


@dataclass
class Labels:
    """The label model: the toxic class's share, P(vote | class, the parent's vote) [class, voter, vote of parent], each voter's parent or -1."""

    share: float
    fires: np.ndarray
    parent: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each pattern [pattern, voter] of 0 and 1."""
        score = np.full(len(patterns), np.log(self.share / (1 - self.share)))
        for j, u in enumerate(self.parent):
            given = patterns[:, u] if u >= 0 else np.zeros(len(patterns), np.int64)
            clean, toxic = self.fires[0, j][given], self.fires[1, j][given]
            score += np.where(patterns[:, j] == 1, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean)))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: Of each voter that voted: P(toxic | it votes). Of each dependent pair of voters: their correlation within the classes.
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: dict[tuple[str, str], float] = field(default_factory=dict)


def _hash_words(words: list[str]) -> np.ndarray:
    return np.concatenate([word_hashes(np.frombuffer(w.encode(), np.uint8), space=MARKS)[0] for w in words])


def features(texts: list[bytes]) -> Features:
    buf, starts = joined(texts)
    low = folded(buf)
    own, begin, end = word_hashes(low, space=MARKS)
    text = np.searchsorted(starts, begin, "right") - 1
    out = np.zeros((len(own), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = own
    with np.errstate(over="ignore"):
        for j, p in enumerate(PREFIXES, 1):
            long = np.flatnonzero(end - begin > p)
            h = np.full(len(long), p, np.uint64)
            for i in range(p):
                h = h + _MIX[low[begin[long] + i]] * powers(p)[i]
            out[long, j] = mixed(h) | np.uint64(1)
    letter = ~MARKS[buf]
    # marks in place of letters: two or more of MASK on end between letters
    edge = np.diff(np.concatenate([[0], MASK[buf].view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    masked = np.zeros(len(buf), bool)
    masked[first[(last - first >= 2) & letter[first - 1] & (first > 0) & letter[np.minimum(last, len(buf) - 1)]]] = True
    stretched = np.zeros(len(buf), bool)
    if len(buf) > 2:
        stretched[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & (low[2:] >= 97) & (low[2:] <= 122)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])
    return Features(text, out, np.bincount(text, minlength=len(texts))[: len(texts)], sums(buf != low), sums(buf == 33), sums(masked), sums(stretched))


def _found(x: Features, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry) of every hit."""
    rows, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(lexicon.hashes):
        for j in range(x.hashes.shape[1]):
            at = np.minimum(np.searchsorted(lexicon.hashes, x.hashes[:, j]), len(lexicon.hashes) - 1)
            hit = np.flatnonzero(lexicon.hashes[at] == x.hashes[:, j])
            rows.append(x.text[hit])
            entries.append(at[hit])
    return np.concatenate(rows), np.concatenate(entries)


def _hits(x: Features, rows: np.ndarray, entries: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n, k = len(x.words), len(VOTERS)
    return np.bincount(rows * k + lexicon.voter[entries], minlength=n * k).reshape(n, k)


def votes(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """[text, voter] of 1 toxic, 0 silent, in the order of VOTERS."""
    x = features(texts)
    hits = _hits(x, *_found(x, lexicon), lexicon)
    out = (hits > 0) & (hits * WORDS_A_HIT >= x.words[:, None])
    told = ((x.words >= 5) & (x.capitals > 2 * x.words), x.shouts > 0.5 * np.maximum(x.words, 1), x.masked > 0, x.stretched > 0)
    for name, fires in zip(PATTERNS, told, strict=True):
        out[:, VOTERS.index(name)] = fires
    return out.astype(np.int8)


class Sparse(NamedTuple):
    """Values of a matrix by ascending row; what isn't listed is 0."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def times(self, w: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], n)

    def turned_times(self, y: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * y[self.rows], d)


def vectors(texts: list[bytes], lexicon: Lexicon) -> Sparse:
    """[text, feature] for the classifier: whether each entry occurs, the logarithm of each voter's hits, and the shares of capitals and shouts."""
    x = features(texts)
    found = _found(x, lexicon)
    k = len(lexicon.hashes)
    row, entry = np.unique(np.stack(found, axis=1), axis=0).T if len(found[0]) else found
    others = np.zeros((len(texts), len(VOTERS) + 2))
    others[:, :-2] = np.log1p(_hits(x, *found, lexicon))
    others[:, -2], others[:, -1] = np.minimum(1, x.capitals / np.maximum(x.words * 5, 1)), np.minimum(1, x.shouts / np.maximum(x.words, 1))
    at, other = np.nonzero(others)
    rows, columns, values = np.concatenate([row, at]), np.concatenate([entry, k + other]), np.concatenate([np.ones(len(row)), others[at, other]])
    order = np.argsort(rows, kind="stable")
    return Sparse(rows[order], columns[order], values[order])


@resting
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, kind, toxic, clean documents) for slices of labelled rows; kind is 0 for words, else the place of the prefix."""
    for part, texts in text_chunks(batches):
        x = features(texts)
        toxic = np.array(part["toxic"].to_pylist(), np.int64)
        kinds = x.hashes.shape[1]
        pair = np.stack([np.repeat(x.text, kinds), signed(x.hashes.ravel()), np.tile(np.arange(kinds), len(x.text))], axis=1)
        pair = pair[pair[:, 1] != 0]
        if not len(pair):
            continue
        pair = pair[np.lexsort((pair[:, 0], pair[:, 1]))]
        pair = pair[np.concatenate([[True], (np.diff(pair[:, :2], axis=0) != 0).any(axis=1)])]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(pair[:, 1])) + 1])
        hot = np.add.reduceat(toxic[pair[:, 0]], edge)
        yield pa.RecordBatch.from_pydict({"feature": pair[edge, 1], "kind": pa.array(pair[edge, 2], pa.int32()), "toxic": hot, "clean": np.diff(np.concatenate([edge, [len(pair)]])) - hot})


def learn_lexicon(sample: DataFrame, least: int = 3) -> Lexicon:
    """The fixed words, and the features of the sample (text, toxic) that toxic documents favour so much that chance would bring less than one
    of them: by the likelihood ratio G of a feature's toxic and clean documents against the sample's, exp(-G / 2) times the number of
    features with `least` toxic documents is below 1, and the odds are e^1.5 times the sample's or more."""
    sizes = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    hot, cold = int(sizes["t"] or 0), int((sizes["n"] or 0) - (sizes["t"] or 0))
    fixed = [np.unique(_hash_words(words.split())) for words in INSULTS.values()]
    hashes, weight, voter = list(fixed), [np.full(len(x), 2.0) for x in fixed], [np.full(len(x), i) for i, x in enumerate(fixed)]
    if hot and cold:
        counts = sample.mapInArrow(_occurrences, schema("feature long, kind int, toxic long, clean long")).groupBy("feature").agg(F.min("kind").alias("kind"), F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(f"t >= {least}")
        counts = staged(counts)
        odds = F.log((F.col("t") + 0.1) / (hot + 0.2)) - F.log((F.col("c") + 0.1 * cold / hot) / (cold + 0.2 * cold / hot))
        part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (hot + cold) / ((F.col("t") + F.col("c")) * of))).otherwise(0.0)
        ratio = 2 * (part("t", hot) + part("c", cold))
        top = counts.select("feature", "kind", odds.alias("odds"), ratio.alias("g")).where(F.col("odds") > 1.5).where(F.col("g") > 2 * np.log(max(counts.count(), 1))).collect()
        unstage(counts)
        own, kind = np.array([r["feature"] for r in top], np.int64).view(np.uint64), np.array([r["kind"] for r in top], np.int64)
        hashes.append(own)
        weight.append(np.array([r["odds"] for r in top]))
        voter.append(VOTERS.index("words_0") + np.where(kind == 0, (mixed(own) % np.uint64(DEALT)).astype(np.int64), DEALT - 1 + kind))
    # a fixed word stays in its first list
    every, at = np.unique(np.concatenate(hashes), return_index=True)
    return Lexicon(every, np.concatenate(weight)[at], np.concatenate(voter)[at].astype(np.int64))


def _forest(strength: np.ndarray, least: float) -> np.ndarray:
    """The parent of each node, or -1, in a spanning forest of the strongest edges of at least `least`."""
    k = len(strength)
    tree, links = list(range(k)), [[] for _ in range(k)]
    edges = [(i, j) for i in range(k) for j in range(i + 1, k) if strength[i, j] >= least]
    for i, j in sorted(edges, key=lambda e: (-strength[e], e)):
        if tree[i] != tree[j]:
            tree = [tree[i] if t == tree[j] else t for t in tree]
            links[i].append(j)
            links[j].append(i)
    parent, seen = np.full(k, -1), set()
    for root in range(k):
        todo = [root] if root not in seen else []
        seen.add(root)
        for node in todo:
            for other in links[node]:
                if other not in seen:
                    seen.add(other)
                    parent[other] = node
                    todo.append(other)
    return parent


def _tallies(x: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    return float(share.sum()), share @ x, (x * share[:, None]).T @ x


def _dependence(n: float, one: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters, times n."""
    out = np.zeros_like(both)
    for cell, rows, columns in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], n - one[None, :]), (one[None, :] - both, n - one[:, None], one[None, :]), (n - one[:, None] - one[None, :] + both, n - one[:, None], n - one[None, :])):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(cell > 1e-9, cell * np.log(cell * n / (rows * columns)), 0)
    np.fill_diagonal(out, 0)
    return np.nan_to_num(out)


def label_model(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None, rounds: int = 100, shaping: int = 5) -> Labels:
    """Generative model over vote patterns [pattern, voter] of 0 and 1 with counts, by expectation maximisation.

    Within a class each voter depends on its parent at most. The parents are the forest of the strongest dependences within the classes that
    make up for their parameters (by the Bayesian information criterion), found anew in the first `shaping` rounds. A copy of its parent thus
    counts for nothing, and voters that only the class ties together count in full. gold [pattern, 2] are counts of clean and toxic labels
    that are known; at every size they weigh as much in the tallies as all documents together, so that the classes stay what the labels
    mean. Without them, toxic is where two voters agree to begin with.
    """
    x, k = patterns.astype(np.float64), patterns.shape[1]
    total = max(float(counts.sum()), 1e-9)
    post = np.select([x.sum(axis=1) >= 2, x.sum(axis=1) == 1], [0.9, 0.3], 0.02)
    known = np.zeros((len(patterns), 2))
    if gold is not None and gold.any(axis=0).all():
        known = gold * (total / gold.sum())
        post = (gold[:, 1] + post) / (gold.sum(axis=1) + 1)
    weight = total + known.sum()
    parent = np.full(k, -1)
    model = Labels(0.5, np.full((2, k, 2), 0.5), parent)
    for at in range(rounds):
        told = [_tallies(x, counts * (1 - post) + known[:, 0]), _tallies(x, counts * post + known[:, 1])]
        if at < shaping:
            parent = _forest(sum(_dependence(*t) for t in told), 2 * np.log(weight + 1))
        fires = np.zeros((2, k, 2))
        for c, (n, one, both) in enumerate(told):
            usual = (one + 0.5) / (n + 1)
            for j, u in enumerate(parent):
                seen, times = (np.array([n, n]), np.array([one[j], one[j]])) if u < 0 else (np.array([n - one[u], one[u]]), np.array([one[j] - both[j, u], both[j, u]]))
                fires[c, j] = (times + usual[j]) / (seen + 1)
        model = Labels(float(np.clip(told[1][0] / weight, 1e-4, 1 - 1e-4)), np.clip(fires, 1e-6, 1 - 1e-6), parent)
        new = model.posterior(patterns)
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-5 and at >= shaping:
            break
    return model


def train_linear(x: Sparse, n: int, d: int, y: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression of n rows with d features on soft labels by Newton steps, each solved by conjugate gradients."""
    squares = x._replace(values=x.values**2)
    w, keep = np.zeros(d + 1), np.append(np.full(d, ridge), 1e-6)
    ahead = lambda v: x.times(v[:-1], n) + v[-1]
    back = lambda r, m=x: np.append(m.turned_times(r, d), r.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        usual = back(curve, squares) + keep
        step, left = np.zeros(d + 1), back(y - p) - keep * w
        least, way = 1e-8 * float(left @ (left / usual)), left / usual
        now = float(left @ way)
        for _ in range(200):
            if now <= least:
                break
            bent = back(curve * ahead(way)) + keep * way
            far = now / float(way @ bent)
            step += far * way
            left = left - far * bent
            now, before = float(left @ (left / usual)), now
            way = left / usual + now / before * way
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def _patterns(lexicon: Lexicon):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            found, times = np.unique(votes(texts, lexicon), axis=0, return_counts=True)
            yield pa.RecordBatch.from_pydict({"votes": pa.array([r.tobytes() for r in found], pa.binary()), "n": pa.array(times, pa.int64())})

    return run


def _voted(lexicon: Lexicon):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            v, x = votes(texts, lexicon), vectors(texts, lexicon)
            edge = np.searchsorted(x.rows, np.arange(len(texts) + 1))
            body = [x.columns[i:j].astype(np.int32).tobytes() + x.values[i:j].astype(np.float32).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"toxic": part["toxic"].cast(pa.int32()), "votes": pa.array([r.tobytes() for r in v], pa.binary()), "x": pa.array(body, pa.binary())})

    return run


def _as_votes(rows: list) -> np.ndarray:
    return np.array([np.frombuffer(bytes(r["votes"]), np.int8) for r in rows]).astype(np.int64).reshape(-1, len(VOTERS))


def fit(labelled: DataFrame, docs: DataFrame, sample: int = 20_000) -> Model:
    """labelled: (doc_id, toxic), all of it may be learned from. At most about `sample` labelled documents, by hash, teach the learned lists
    and the classifier, with the label model's posteriors as labels; the bound keeps the fit's cost and what the driver holds (that many
    short vectors) the same at every input size. The label model is fitted to the votes on all of docs (doc_id, text), labelled or not; the
    driver gets the distinct patterns with their counts, 2 ** len(VOTERS) at most. Rows with a null label or text don't teach."""
    marked = labelled.where("toxic is not null and doc_id is not null").select("doc_id", F.expr("if(toxic > 0, 1, 0)").alias("toxic")).dropDuplicates(["doc_id"])
    total = marked.count()
    if total > sample:
        marked = marked.where(F.xxhash64("doc_id").between(F.lit(-(2**63)), F.lit(int(-(2**63) + sample / total * (2**64 - 1)))))
    texts = docs.select("doc_id", "text").where("text is not null")
    known = staged(texts.join(F.broadcast(staged(marked)), "doc_id").select("text", "toxic"))
    lexicon = learn_lexicon(known)
    rows = known.mapInArrow(_voted(lexicon), schema("toxic int, votes binary, x binary")).collect()
    if not rows:
        return Model(lexicon, lexicon.weight, -3.0)
    seen = texts.mapInArrow(_patterns(lexicon), schema("votes binary, n long")).groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    patterns, counts = _as_votes(seen), np.array([r["n"] for r in seen], np.float64)
    place = {bytes(r["votes"]): i for i, r in enumerate(seen)}
    gold = np.zeros((len(patterns), 2))
    for r in rows:
        gold[place[bytes(r["votes"])], r["toxic"]] += 1
    labels = label_model(patterns, counts, gold)
    body = [bytes(r["x"]) for r in rows]
    size = [len(b) // 8 for b in body]
    x = Sparse(
        np.repeat(np.arange(len(rows)), size),
        np.concatenate([np.frombuffer(b[: 4 * n], np.int32) for b, n in zip(body, size, strict=True)]).astype(np.int64),
        np.concatenate([np.frombuffer(b[4 * n :], np.float32) for b, n in zip(body, size, strict=True)]).astype(np.float64),
    )
    w, bias = train_linear(x, len(rows), len(lexicon.hashes) + len(VOTERS) + 2, labels.posterior(_as_votes(rows)))
    post, fired = labels.posterior(patterns), counts @ patterns
    right = {v: float((counts * post) @ patterns[:, j] / fired[j]) for j, v in enumerate(VOTERS) if fired[j]}
    return Model(lexicon, w, bias, right, _correlations(patterns, counts, post, labels.parent))


def _correlations(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray, parent: np.ndarray) -> dict[tuple[str, str], float]:
    """Of each voter with its parent, within the classes: the mean of both classes' correlations by size."""
    out = dict.fromkeys([(VOTERS[u], VOTERS[j]) for j, u in enumerate(parent) if u >= 0], 0.0)
    for share in (counts * (1 - post), counts * post):
        n, one, both = _tallies(patterns.astype(np.float64), share)
        for j, u in enumerate(parent):
            sd = np.sqrt(max(one[j] * (n - one[j]) * one[u] * (n - one[u]), 0.0)) if u >= 0 else 0
            if sd > 0:
                out[VOTERS[u], VOTERS[j]] += float(n / counts.sum() * (n * both[j, u] - one[j] * one[u]) / sd)
    return out


def _scored(model: Model):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(len(model.lexicon.hashes) + len(VOTERS) + 2)
        w[: len(model.weights)] = model.weights
        for part, texts in text_chunks(batches, size=WINDOW):
            s = vectors(texts, model.lexicon).times(w, len(texts)) + model.bias
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].cast(pa.int64()), "score": p.astype(np.float64), "predicted": (p >= 0.5).astype(np.int32)})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) for each row of docs (doc_id, text), from whole texts.

    One pass without a shuffle. A null or empty text scores the bias alone; null doc_ids, repeated rows and copies keep a row each; an empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scored(model), schema("doc_id long, score double, predicted int"))
