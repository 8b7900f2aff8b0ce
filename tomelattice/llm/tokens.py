"""Vectorised tokens and shingles, shared by the text operators.

A token is, after NFKC and lower-casing, one character of U+4E00-U+9FFF or a longest run of other
letters and digits.  Texts are handled in batches: all characters of a batch become one code point
array, classes and token borders come from table lookups, and every token and shingle is a 64-bit
hash, so no Python object is made per token.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_CODES = 0x110000
_PAD = 0  # code of the separator put between texts

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Table:
    """What normalisation makes of single code points, filled in as code points turn up."""

    def __init__(self) -> None:
        self.known = np.zeros(_CODES, bool)
        self.kind = np.zeros(_CODES, np.uint8)  # 0 separates, 1 ideograph, 2 letter or digit
        self.value = np.zeros(_CODES, np.uint64)  # hash of the normalised code point
        self.whole = np.zeros(_CODES, bool)  # needs normalisation with its neighbours
        self.powers = np.ones(1, np.uint64)

    def learn(self, codes: np.ndarray) -> None:
        seen = np.zeros(_CODES, bool)
        seen[codes] = True
        for cp in np.flatnonzero(seen & ~self.known).tolist():
            c = chr(cp)
            n = unicodedata.normalize("NFKC", c).lower() if not 0xD800 <= cp < 0xE000 else c
            single = len(n) == 1
            # Code points that may join or reorder with neighbours, or whose lower case depends on them.
            jamo = any(0x1100 <= ord(x) < 0x1200 or 0xA960 <= ord(x) < 0xA980 or 0xD7B0 <= ord(x) < 0xD800 for x in c + n)
            joins = jamo or cp == 0x3A3 or any(unicodedata.combining(x) or unicodedata.category(x)[0] == "M" for x in c + n)
            if joins or (not single and any(x.isalnum() for x in n)):
                self.whole[cp] = True
                n = c
            o = ord(n[0])
            self.kind[cp] = (1 if 0x4E00 <= o <= 0x9FFF else 2 if n.isalnum() else 0) if len(n) == 1 else 0
            self.value[cp] = mix64(np.array([o + 1], np.uint64) * _P)[0]
        self.known |= seen

    def power(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, 0xD6E8FEB86659FD93, np.uint64))])
        return self.powers


_table = _Table()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a separator after each, and where each text begins."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


def tokenize(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch and offsets: text i has tokens[offsets[i]:offsets[i + 1]]; null is as empty."""
    texts = [t or "" for t in texts]
    codes, begins = _codes(texts)
    _table.learn(codes)
    odd = _table.whole[codes]
    if odd.any():
        for i in np.unique(np.searchsorted(begins, np.flatnonzero(odd), "right") - 1).tolist():
            texts[i] = unicodedata.normalize("NFKC", texts[i]).lower()
        codes, begins = _codes(texts)
        _table.learn(codes)
    kind = _table.kind[codes]
    word = kind == 2
    first = kind == 1
    first[1:] |= word[1:] & ~word[:-1]
    first[0] |= word[0]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    value = _table.value[codes]
    value[kind == 0] = 0
    # Characters after the first of a run are weighted by their place in it.
    later = np.flatnonzero(word & ~first)
    if len(later):
        place = later - starts[np.searchsorted(starts, later, "right") - 1]
        value[later] *= _table.power(int(place.max()) + 1)[place]
    return mix64(np.add.reduceat(value, starts)), np.searchsorted(starts, begins)


def shingles(tokens: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive tokens, in order of place, and offsets by text; a text of fewer than k tokens has none."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    n = len(tokens) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += mix64(tokens[j : j + n] + np.uint64((j + 1) * 0x2545F4914F6CDD1D % 2**64)) if k <= 8 else tokens[j : j + n] * np.uint64(pow(0xD1342543DE82EF95, j + 1, 2**64))
    h = mix64(h)
    if out[-1] != n or (counts == 0).any():
        at = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
        h = h[at]
    return h, out


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, and their offsets."""
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        s = np.sort(values[a:b])
        if b - a > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        parts.append(s)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
