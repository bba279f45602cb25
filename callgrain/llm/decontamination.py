"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and of documents are canonical: numbers, names and units become typed placeholders, other words are folded; and once
more with names as words, as text in other case has none. Windows of template words are hashed and joined; windows that line up between an item and a document then have their slots checked: one value of the
item must stand for one value of the document throughout, and two for two; windows with a slot that breaks this don't count. So copies are found, and questions with other numbers or names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import MARKS, folded, joined, mixed, powers, resting, schema, text_chunks, word_hashes

#: Units of measure that stand after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents km/h mph kmh meter meters metre metres kilometer kilometers kilogram kilograms gram grams liter liters litre litres mile miles foot feet inch inches pound pounds hz khz mhz ghz kb mb gb tb w kw mw v a".split()
WORD, NUMBER, NAME, UNIT = range(4)
HOLDERS = np.array([0, 0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547], np.uint64)
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n\r:;\"'()[]{}|*#>"]] = True


def _hash_of(words: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([word_hashes(np.frombuffer(w.encode(), np.uint8), space=MARKS)[0] for w in words]))


UNIT_HASHES = _hash_of(UNITS)


@dataclass
class Canonical:
    """Words of some texts: template hash, type, own hash, and where each text's words start; literal words are neither slots nor names."""

    template: np.ndarray
    kind: np.ndarray
    own: np.ndarray
    cut: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    literal: np.ndarray


def canonical(texts: list[bytes], names: bool = True) -> Canonical:
    """names: names are slots, and a name of several words is one; else they are words like others, whatever their case."""
    buf, starts = joined(texts)
    low = folded(buf)
    own, begin, end = word_hashes(low, space=MARKS)
    cut = np.searchsorted(begin, starts)
    counts = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits, capitals, stops = counts((buf >= 48) & (buf <= 57)), counts(low != buf), counts(STOPS[buf])
    kind = np.zeros(len(own), np.int8)
    if len(own):
        number = digits[end] > digits[begin]
        before = np.concatenate([[0], end[:-1]])
        opens = stops[begin] > stops[before]
        opens[cut[:-1][cut[:-1] < len(own)]] = True  # the first word of a text
        wide = np.where(buf[begin] == 0xC3, 2, 1)
        first = capitals[np.minimum(begin + wide, end)] > capitals[begin]
        more = capitals[end] > capitals[np.minimum(begin + wide, end)]
        kind[first & ~more & ~opens] = NAME
        kind[number] = NUMBER
        at = np.minimum(np.searchsorted(UNIT_HASHES, own), len(UNIT_HASHES) - 1)
        kind[1:][(UNIT_HASHES[at] == own)[1:] & number[:-1] & ~number[1:]] = UNIT
    literal = kind == WORD
    if not names:
        kind[kind == NAME] = WORD
    joint = np.zeros(len(own), bool)  # goes on with the name before it
    if len(own) > 1:
        joint[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (begin[1:] == end[:-1] + 1) & (buf[end[:-1]] == 32)
    if joint.any():
        head = np.flatnonzero(~joint)
        with np.errstate(over="ignore"):
            place = np.arange(len(own)) - np.repeat(head, np.diff(np.concatenate([head, [len(own)]])))
            own = np.add.reduceat(np.where(place > 0, mixed(own + place.astype(np.uint64)), own), head)
        kind, literal, begin, end = kind[head], literal[head], begin[head], end[np.concatenate([head[1:], [len(joint)]]) - 1]
        cut = np.searchsorted(begin, starts)
    return Canonical(np.where(kind > 0, HOLDERS[kind], own), kind, own, cut, begin, end, starts, literal)


def windows(c: Canonical, width: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Template hash of the window that starts at each word, and whether it lies in one text and holds enough literal words."""
    n = max(0, len(c.own) - width + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = mixed(h ^ c.template[i : i + n]) + np.uint64(i + 1)
    words = np.concatenate([[0], np.cumsum(c.kind == WORD)])
    text = np.searchsorted(c.cut, np.arange(len(c.own)), "right")
    return h, (text[:n] == text[width - 1 : width - 1 + n]) & (words[width : width + n] - words[:n] >= literal)


def sums(words: np.ndarray) -> np.ndarray:
    """Sums of the words' hashes times powers of an odd number, from which stretches() has the hash of a stretch of any length."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words)), dtype=np.uint64)])


def stretches(s: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the stretch of so many words that starts at each place: the same stretch has the same hash anywhere."""
    with np.errstate(over="ignore"):
        back = np.full(len(s), pow(int(powers(2)[1]), -1, 1 << 64), np.uint64)
        back[0] = 1
        return (s[at + length] - s[at]) * np.cumprod(back, dtype=np.uint64)[at]


class Benchmark:
    """A block of items: their windows sorted by hash, and the hashes of items that have no window. Held by every task; callers bound its size."""

    def __init__(self, items: list[tuple[int, str]], width: int, literal: int, names: bool = True):
        self.width, self.literal, self.ids, self.names = width, literal, [i for i, _ in items], names
        #: The same items with names as words: so copies in other cases are found, where names can't be told.
        self.plain = Benchmark(items, width, literal, False) if names else None
        c = canonical([(t or "").encode() for _, t in items], names)
        h, good = windows(c, width, literal)
        told = np.concatenate([[0], np.cumsum(c.literal)])
        at = np.flatnonzero(good & (told[width:][: len(good)] - told[: len(good)] >= literal))
        at = at[np.argsort(h[at], kind="stable")]
        self.hash, self.item = h[at], (np.searchsorted(c.cut, at, "right") - 1).astype(np.int64)
        self.place = at - c.cut[self.item]
        self.size = np.bincount(self.item, minlength=len(items))
        self.kind, self.own, self.cut = c.kind, c.own, c.cut
        # items without a window: all their words are one, as they stand, and as a template too if that has enough literal words
        length = np.diff(c.cut)
        whole = np.flatnonzero((self.size == 0) & (length > 0))
        self.size[whole] = 1
        words = np.concatenate([[0], np.cumsum(c.kind == WORD)])
        plenty = whole[words[c.cut[whole + 1]] - words[c.cut[whole]] >= literal]
        self.whole: list[tuple[bool, int, np.ndarray, np.ndarray]] = []  # by own words or template, length, hashes in order, items
        for own, some in ((True, whole), (False, plenty)):
            s = sums(c.own if own else c.template) if len(some) else None
            for n in np.unique(length[some]).tolist():
                these = some[length[some] == n]
                h = stretches(s, c.cut[these], n)
                order = np.argsort(h, kind="stable")
                self.whole.append((own, n, h[order], these[order]))


def consistent(ours: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether values match one to one throughout."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(ours.tolist(), theirs.tolist(), strict=True))


def conflicting(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which slots conflict with others: all but those whose two values stand for each other more often than for any other value."""
    pairs, which, times = np.unique(np.stack([ours, theirs], axis=1), axis=0, return_inverse=True, return_counts=True)
    good = np.ones(len(pairs), bool)
    for side in (0, 1):
        value = np.unique(pairs[:, side], return_inverse=True)[1].ravel()
        most = np.zeros(len(pairs), np.int64)
        np.maximum.at(most, value, times)
        rivals = np.bincount(value[times == most[value]], minlength=len(pairs))
        good &= (times == most[value]) & (rivals[value] == 1)
    return ~good[which.ravel()]


def _joined(h: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index into hashes) for all equal hashes; hashes are in order."""
    lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    many = hi - lo
    at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
    return np.repeat(at, many), np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _slots(c: Canonical, bench: Benchmark, item: int, shift: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words that aligned windows of an item cover, which of them are slots, and the slots' values in the item and in the text."""
    offsets = np.unique((at[:, None] + np.arange(bench.width)).ravel())
    ours, theirs = offsets + bench.cut[item], offsets + shift
    slots = (bench.kind[ours] > 0) & (c.kind[theirs] > 0)
    return offsets, slots, bench.own[ours][slots], c.own[theirs][slots]


def _aligned(c: Canonical, bench: Benchmark, found: Callable) -> None:
    """Runs of aligned windows; those that cover a conflicting slot don't count."""
    h, good = windows(c, bench.width, bench.literal)
    at = np.flatnonzero(good)
    if not len(at) or not len(bench.hash):
        return
    word, hit = _joined(h[at], at, bench.hash)
    if not len(word):
        return
    text, item, shift = np.searchsorted(c.cut, word, "right") - 1, bench.item[hit], word - bench.place[hit]
    order = np.lexsort((word, shift, item, text))
    text, item, shift, word, place = text[order], item[order], shift[order], word[order], bench.place[hit][order]
    edge = np.flatnonzero(np.diff(text) | np.diff(item) | np.diff(shift)) + 1
    for a, b in zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(text)]]).tolist(), strict=True):
        at, begin = place[a:b], word[a:b]
        offsets, slots, x, y = _slots(c, bench, item[a], shift[a], at)
        if not consistent(x, y):
            wrong = offsets[slots][conflicting(x, y)]
            clear = np.searchsorted(wrong, at, "left") == np.searchsorted(wrong, at + bench.width, "left")
            at, begin = at[clear], begin[clear]
            if not len(at):
                continue
            offsets, slots, x, y = _slots(c, bench, item[a], shift[a], at)
        gaps = np.flatnonzero(np.diff(offsets) > 1) + 1
        longest = int(np.diff(np.concatenate([[0], gaps, [len(offsets)]])).max())
        found(int(text[a]), int(item[a]), at.tolist(), bool((x != y).any()), int(begin[0]), int(begin[-1]) + bench.width - 1, longest)


def _whole(c: Canonical, bench: Benchmark, found: Callable) -> None:
    """Items that have no window, where all their words stand in a text."""
    held: dict[bool, np.ndarray] = {}
    for own, length, hashes, items in bench.whole:
        if len(c.own) < length:
            continue
        if own not in held:
            held[own] = sums(c.own if own else c.template)
        at = np.arange(len(c.own) - length + 1)
        word, hit = _joined(stretches(held[own], at, length), at, hashes)
        text, item = np.searchsorted(c.cut, word, "right") - 1, items[hit]
        inside = word + length <= c.cut[text + 1]
        text, item, word = text[inside], item[inside], word[inside]
        if own:  # the first and the last place of each text and item tell all
            order = np.lexsort((word, item, text))
            text, item, word = text[order], item[order], word[order]
            new = (np.diff(text) | np.diff(item)) != 0
            ends = np.concatenate([[True], new]) | np.concatenate([new, [True]]) if len(text) else np.zeros(0, bool)
            text, item, word = text[ends], item[ends], word[ends]
        for t, i, w in zip(text.tolist(), item.tolist(), word.tolist(), strict=True):
            ours, theirs = slice(bench.cut[i], bench.cut[i] + length), slice(w, w + length)
            slots = (bench.kind[ours] > 0) & (c.kind[theirs] > 0)
            x, y = bench.own[ours][slots], c.own[theirs][slots]
            if own or consistent(x, y):
                found(t, i, [0], not own and bool((x != y).any()), w, w + length - 1, 0)


def matches(texts: list[bytes], bench: Benchmark, share: float, run: int = 50) -> list[tuple[int, int, float, bool, int, int]]:
    """(text, item, share of the item's windows, whether slots differ, start byte, end byte), one for each text and item: with names as words, or
    where that finds nothing, with names as slots."""
    words = _matches(texts, bench.plain, share, run) if bench.plain else []
    known = {x[:2] for x in words}
    return words + [x for x in _matches(texts, bench, share, run) if x[:2] not in known]


def _matches(texts: list[bytes], bench: Benchmark, share: float, run: int) -> list[tuple[int, int, float, bool, int, int]]:
    c = canonical(texts, bench.names)
    best: dict[tuple[int, int], list] = {}

    def found(text: int, item: int, places: list[int], other: bool, first: int, last: int, longest: int) -> None:
        x = best.setdefault((text, item), [set(), False, len(c.own), 0, 0])
        x[0].update(places)
        x[1:] = x[1] | other, min(x[2], first), max(x[3], last), max(x[4], longest)

    _aligned(c, bench, found)
    _whole(c, bench, found)
    out = []
    for (t, i), (places, other, first, last, longest) in best.items():
        if len(places) >= share * bench.size[i] or longest >= run:
            out.append((t, bench.ids[i], len(places) / int(bench.size[i]), other, int(c.begin[first] - c.starts[t]), int(c.end[last] - c.starts[t])))
    return out


def _matched(bench: Benchmark, share: float, least: int):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            if found := matches(texts, bench, share, least):
                docs = part["doc_id"].cast(pa.int64()).to_pylist()
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[t] for t in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                    names=["doc_id", "item_id", "share", "reparameterised", "start_byte", "end_byte"],
                )

    return run


def _kept(bench: Benchmark, share: float, least: int):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            out = {t for t, *_ in matches(texts, bench, share, least)}
            yield part if not out else part.filter(pa.array([i not in out for i in range(len(texts))]))

    return run


def _blocks(benchmark: DataFrame, width: int, literal: int, most_chars: int) -> Iterator[Benchmark]:
    """Blocks of the benchmark that the driver can hold and send: their number follows the benchmark's size, so each has about most_chars at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most_chars)
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Benchmark([(r["item_id"], r["text"]) for r in own.collect()], width, literal)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 5, share: float = 0.5, most_chars: int = 20_000_000, run: int = 50) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text) where at least `share` of the item's windows of `width` template
    words stand in the document, with consistent slots, or where such windows cover `run` words of it on end: doc_id, item_id, share,
    reparameterised, start_byte, end_byte (of the UTF-8 text).

    This is done twice: with names as words, in any case, and with names, of one word or of several, as slots; either will do.
    Windows with fewer than `literal` words besides placeholders don't count, nor do those of an aligned run that cover a conflicting slot:
    a value's most frequent partner holds, and where two are as frequent, neither does. An item without such a window (a short one, or one dense in
    numbers and names) is one window as a whole: it matches word for word (in any case and punctuation, however short it is), and with
    other slots too if it has `literal` words besides placeholders. Items without a word match nothing. The benchmark is held by
    tasks in blocks of about most_chars, one pass over the documents each, so neither side is ever shuffled and a passage that many
    documents share costs each of them alone. Null and empty texts match nothing; null doc_ids stay null; repeated rows and items match
    each; other columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = schema("doc_id long, item_id long, share double, reparameterised boolean, start_byte long, end_byte long")
    out = docs.sparkSession.createDataFrame([], kind)
    for bench in _blocks(benchmark, width, literal, most_chars):
        out = out.unionByName(docs.mapInArrow(_matched(bench, share, run), kind))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 5, share: float = 0.5, most_chars: int = 20_000_000, run: int = 50) -> DataFrame:
    """The rows of docs that match no item, by the same rule; all columns stay."""
    kept = docs
    for bench in _blocks(benchmark, width, literal, most_chars):
        kept = kept.mapInArrow(_kept(bench, share, run), docs.schema)
    return kept
