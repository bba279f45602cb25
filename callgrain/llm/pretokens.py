"""Pre-tokens of the public tokenizers, and what each of them encodes to, remembered by pre-token.

In SAFE ranges the classes \\p{L}, \\p{N} and \\s, lower case and NFC of this Python agree with the tokenizer library at every code point
(tests/llm/test_tokens.py compares all of them); a text with any other character is cut by the library itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
UNSAFE = regex.compile(r"[^\x00-ԯ -⁤₠-₿ぁ-ゖァ-ヺ一-鿯가-힣]")
#: Pre-tokens remembered by one worker; beyond them it starts anew.
REMEMBERED = 700_000


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials(path: str) -> dict[str, int]:
    return {x.content: i for i, x in library(path).get_added_tokens_decoder().items()}


class ByteLevel:
    """Byte-level BPE without a normalizer: counts."""

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    #: The same on ASCII alone, where the standard library is twice as fast.
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")

    def __init__(self, path: str):
        self.path, self.tokenizer = path, library(path)
        self.special = regex.compile("|".join(map(regex.escape, specials(path))) or r"(?!)")
        self.whole = dict.fromkeys(whole_tokens(path), 1)
        self.known = dict(self.whole)

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.ASCII.findall(text)
        if not UNSAFE.search(text):
            return self.PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, missing: list[str]) -> None:
        """Run the merges for pre-tokens that are no whole token; all at once, a line feed between them."""
        plain = [x for x in missing if not x[-1].isspace() and "\n" not in x]
        for x in set(missing).difference(plain):
            self.known[x] = len(self.tokenizer.encode(x, add_special_tokens=False).ids)
        for first in range(0, len(plain), 5000):
            part = plain[first : first + 5000]
            counts = np.bincount([w for w in self.tokenizer.encode("\n".join(part), add_special_tokens=False).word_ids if w is not None])
            if len(counts) == 2 * len(part) - 1:
                self.known.update(zip(part, counts[::2].tolist(), strict=True))
            else:
                self.known.update((x, len(self.tokenizer.encode(x, add_special_tokens=False).ids)) for x in part)

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = dict(self.whole)
        found = [[self.pre_tokens(x) for x in self.special.split(text)] for text in texts]
        known = self.known
        if missing := set().union(*(part for parts in found for part in parts)).difference(known):
            self.merged(sorted(missing))
        return [sum(sum(map(known.__getitem__, part)) for part in parts) + len(parts) - 1 for parts in found]


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and that the merges make into one token: proved by running each once."""
    tokenizer = library(path)
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    texts = [x for x in tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False) if x and "�" not in x]
    cut = [x for x in texts if len(tokenizer.pre_tokenizer.pre_tokenize_str(x)) == 1]
    added = specials(path)
    return [x for x, e in zip(cut, tokenizer.encode_batch(cut, add_special_tokens=False), strict=True) if len(e.ids) == 1 and x not in added]


class WordEnds:
    """BPE with word ends, NFC, lower case and dropped white space: ids as little-endian 32-bit bytes."""

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: The same on lower-case ASCII.
    ASCII = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t-\ra-z0-9]+")

    def __init__(self, path: str):
        self.path, self.tokenizer = path, library(path)
        self.ids = specials(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.ids)) + ")") if self.ids else None
        self.known: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.ASCII.findall(text.lower())
        if not UNSAFE.search(text):
            # one character at a time, as the library has it: no final sigma
            return self.PATTERN.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, missing: list[str]) -> None:
        for first in range(0, len(missing), 5000):
            part = missing[first : first + 5000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, words = np.array(e.ids, "<u4"), np.array([-1 if w is None else w for w in e.word_ids])
            edges = np.concatenate([[0], np.flatnonzero(np.diff(words)) + 1, [len(ids)]]) if len(ids) else []
            if len(edges) == len(part) + 1:
                self.known.update((x, ids[a:b].tobytes()) for x, a, b in zip(part, edges[:-1], edges[1:], strict=True))
            else:
                self.known.update((x, np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()) for x in part)

    def encoded(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, found = self.known, []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            found.append([self.pre_tokens(x) if i % 2 == 0 else [x] for i, x in enumerate(parts)])
        if missing := set().union(*(part for parts in found for part in parts[::2])).difference(known):
            self.merged(sorted(missing))
        out = []
        for parts in found:
            ids = [b"".join(map(known.__getitem__, part)) if i % 2 == 0 else self.ids[part[0]].to_bytes(4, "little") for i, part in enumerate(parts)]
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out


@lru_cache(maxsize=4)
def encoder(kind: type, path: str):
    """One for each worker."""
    return kind(path)
