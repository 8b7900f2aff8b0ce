"""Text decoded with a wrong charset, found and restored by a hidden Markov model.

The model has one clean state and one state for every way of decoding wrongly: encoded as A, read as
B, once or several times.  It emits the characters above ASCII; the probability of a character
depends on the state, on what kind of character precedes it and on what kind follows.  Emissions are
learned from counts over all texts: clean text as it is, every other state from clean text that was
sent through its encodings; what a first model labels as garbled is taken out of the counts before
the model is learned again.  Viterbi decoding labels the characters, and each labelled
span gets the inverse of its state's transform.
"""

from __future__ import annotations

import codecs
import copy
import functools
import pickle
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomelattice.llm.arrow import text_batches

#: The states other than clean: the steps (encoded as, read as) that a text went through.
PAIRS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8>latin-1": (("utf-8", "latin-1"),),
    "utf-8>cp1252": (("utf-8", "cp1252"),),
    "utf-8>mac-roman": (("utf-8", "mac-roman"),),
    "utf-8>gbk": (("utf-8", "gbk"),),
    "utf-8>cp1251": (("utf-8", "cp1251"),),
    "gbk>latin-1": (("gbk", "latin-1"),),
    "gbk>cp1251": (("gbk", "cp1251"),),
    "gbk>utf-8": (("gbk", "utf-8"),),
    "gbk>utf-8>gbk": (("gbk", "utf-8"), ("utf-8", "gbk")),
    "utf-8>latin-1 twice": (("utf-8", "latin-1"),) * 2,
    "utf-8>cp1252 twice": (("utf-8", "cp1252"),) * 2,
    "cp850>cp1252": (("cp850", "cp1252"),),
    "latin-1>utf-8": (("latin-1", "utf-8"),),
}
#: Passes over the texts that the model is learned in.
PASSES = 3
#: Log probabilities of entering and of leaving a garbled state.
ENTER, LEAVE = -8.0, -3.0
#: Share of emissions that any character may have, and its probability then.
_LOOSE, _ANY = 0.01, 1e-5
_CONTROL = re.compile("[\x80-\x9f]")
_QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")

# Kinds of characters, by ranges of code points; a range has one kind or (upper case, others).
_KINDS = [(0x80, 0x9F), (0xA0, 0xBF), (0xC0, 0xDE), (0xDF, 0xFF), (0x100, 0x24F), (0x250, 0x36F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x1FFF), (0x2000, 0x206F), (0x2070, 0x2BFF), (0x3000, 0x303F), (0x3040, 0x30FF), (0x3100, 0x33FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF), (0xFFFD, 0xFFFD)]
SPACE, LOWER, UPPER, DIGIT, SIGN, OTHER = range(6)
_FIRST = 6
KINDS = _FIRST + 2 * len(_KINDS)


def _kind_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(128):
        x = chr(c)
        t[c] = SPACE if x.isspace() or c < 32 else LOWER if x.islower() else UPPER if x.isupper() else DIGIT if x.isdigit() else SIGN
    for k, (a, b) in enumerate(_KINDS):
        for c in range(a, b + 1):
            t[c] = _FIRST + 2 * k + (0x370 <= c < 0x530 and chr(c).isupper())
    return t


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not _kinds:
        _kinds.append(_kind_table())
    return _kinds[0]


# cp1252 as it is mostly read and written: the bytes it lacks are the control characters of latin-1.
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
_BYTE = {ord(c): b for b, c in enumerate(_CP1252)}
_WRITE = {"cp1252": {b: b for b in range(256)} | _BYTE, "latin-1": _BYTE | {b: b for b in range(256)}}


def _encode(text: str, charset: str, errors: str) -> bytes:
    """Text that was read as latin-1 or cp1252 may have characters of the other."""
    if charset in _WRITE:
        return codecs.charmap_encode(text, errors, _WRITE[charset])[0]
    return text.encode(charset, errors)


def _decode(data: bytes, charset: str, errors: str) -> str:
    if charset == "cp1252" and errors == "c1":
        return codecs.charmap_decode(data, "strict", _CP1252)[0]
    return data.decode(charset, "replace" if errors == "c1" else errors)


def garble(text: str, state: str) -> str:
    """What the text becomes by the state's encodings."""
    for true, read in PAIRS[state]:
        text = _decode(text.encode(true, "ignore" if true == "latin-1" else "replace"), read, "c1" if true == "utf-8" else "replace")
    return text


def restore(text: str, state: str) -> tuple[str, bool]:
    """The text before the state's encodings, and whether nothing of it was lost.  Bytes that are gone leave U+FFFD."""
    errors = "strict"
    for true, read in reversed(PAIRS[state]):
        if read == "utf-8" and "�" in text:  # the bytes are gone, and what is left no longer pairs up
            return text, False
        try:
            text = _encode(text, read, errors).decode(true, errors)
        except UnicodeError:
            errors = "replace"
            text = _encode(text.replace("�", "\x1a"), read, "replace").decode(true, "replace").replace("\x1a", "�")
    return text, errors == "strict" and "�" not in text


class Symbols:
    """The characters above ASCII of some texts, with the kinds of their neighbours."""

    def __init__(self, texts: list[str], quotes: bool = True) -> None:
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.places = np.flatnonzero(codes > 127)
        k = kinds()
        self.codes = codes[self.places]
        self.before = k[codes[np.maximum(self.places - 1, 0)]] if len(codes) else np.zeros(0, np.uint8)
        self.before[self.places == 0] = SPACE
        self.after = k[codes[self.places + 1]]
        self.quoted = np.zeros(len(self.places), bool)
        if quotes and "`" in joined:
            for m in _QUOTED.finditer(joined):
                a, b = np.searchsorted(self.places, m.span())
                self.quoted[a:b] = True

    @functools.cached_property
    def text(self) -> np.ndarray:
        return np.searchsorted(self.begins, self.places, "right") - 1

    def only(self, at: np.ndarray) -> Symbols:
        """The symbols of some places."""
        out = copy.copy(self)
        for name in ("places", "codes", "before", "after", "text", "quoted"):
            setattr(out, name, getattr(self, name)[at])
        return out


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    if len(keys) and keys.max() < min(1 << 23, 16 * len(keys)):  # sorting is quicker where cells are mostly empty
        n = np.bincount(keys)
        at = np.flatnonzero(n)
        return at, n[at]
    return np.unique(keys, return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several tallies, without what sums to nothing."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in parts]))
    return keys[n != 0], n[n != 0]


class Counts:
    """How often characters occur, by what kind of character precedes and follows them; all that is kept of texts while learning."""

    def __init__(self, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> None:
        self.before, self.after = before, after
        self.codes = np.unique(before[0] // KINDS)

    @staticmethod
    def of(s: Symbols, used: np.ndarray | slice = slice(None)) -> Counts:
        codes = s.codes[used].astype(np.int64) * KINDS
        return Counts(_tally(codes + s.before[used]), _tally(codes + s.after[used]))

    @staticmethod
    def merged(parts: list[Counts]) -> Counts:
        return Counts(_merged([p.before for p in parts]), _merged([p.after for p in parts]))

    def without(self, other: Counts) -> Counts:
        return Counts(*(_merged([x, (k, -n)]) for x, (k, n) in ((self.before, other.before), (self.after, other.after))))

    def __reduce__(self):
        return _spread, tuple((np.diff(k, prepend=0).astype(np.int32), n) for k, n in (self.before, self.after))

    def tables(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by character of chars (rows) and kind (columns)."""
        out = []
        for keys, n in (self.before, self.after):
            t = np.zeros((len(chars), KINDS))
            t[np.searchsorted(chars, keys // KINDS), keys % KINDS] = n
            out.append(t)
        return out[0], out[1]


def _spread(*pairs: tuple[np.ndarray, np.ndarray]) -> Counts:
    return Counts(*((np.cumsum(steps, dtype=np.int64), n) for steps, n in pairs))


class Model:
    """Gains in log probability of every state over the clean one, by character and neighbours."""

    def __init__(self, clean: Counts, garbled: list[Counts]) -> None:
        chars = np.unique(np.concatenate([s.codes for s in (clean, *garbled)]))
        self.chars, self.clean = chars, clean.codes
        n = len(chars)
        kind = kinds()[chars].astype(int)
        self.follow = np.zeros((n * KINDS, len(garbled)), np.float32)
        self.precede = np.zeros((n * KINDS, len(garbled)), np.float32)
        for k, s in enumerate((clean, *garbled)):
            both, after = s.tables(chars)
            alone = both.sum(axis=1)
            p = (1 - _LOOSE) * alone / max(alone.sum(), 1) + _LOOSE * _ANY
            # Of the preceding kind: its own counts as far as there are any, else those of the state.
            given = (both + 20 * p[:, None]) / (both.sum(axis=0) + 20)
            follow = np.log((1 - _LOOSE) * given + _LOOSE * _ANY)
            by_kind = np.zeros((KINDS, KINDS))
            np.add.at(by_kind, kind, after)
            by_kind = (by_kind + 1) / (by_kind.sum(axis=1, keepdims=True) + KINDS)
            precede = np.log((after + 5 * by_kind[kind]) / (after.sum(axis=1, keepdims=True) + 5))
            if k:
                self.follow[:, k - 1] = (follow - plain[0]).ravel()
                self.precede[:, k - 1] = (precede - plain[1]).ravel()
            else:
                plain = follow, precede
        self.most = self.follow.max(axis=1), self.precede.max(axis=1)
        self.counts = clean, garbled

    def __reduce__(self):
        """Sent as the counts, which are far smaller than the tables made of them."""
        return _unpacked, (zlib.compress(pickle.dumps(self.counts), 1),)

    def _rows(self, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
        c = np.searchsorted(self.chars, s.codes)
        c[c == len(self.chars)] = 0
        return c * KINDS, self.chars[c] == s.codes

    def bounds(self, s: Symbols) -> np.ndarray:
        """What no state's gain exceeds, for every symbol."""
        if not len(self.chars):
            return np.full(len(s.codes), -1.0, np.float32)
        c, known = self._rows(s)
        out = self.most[0][c + s.before] + self.most[1][c + s.after]
        out[~known] = -1
        out[s.quoted] = -50
        return out

    def gains(self, s: Symbols) -> np.ndarray:
        """A row of gains for every symbol; unknown characters and quoted ones speak for the clean state."""
        if not len(self.chars):
            return np.full((len(s.codes), len(PAIRS)), -1.0, np.float32)
        c, known = self._rows(s)
        out = self.follow[c + s.before] + self.precede[c + s.after]
        out[~known] = -1
        out[s.quoted] = -50
        return out


def _unpacked(data: bytes) -> Model:
    return Model(*pickle.loads(zlib.decompress(data)))


def _worth_decoding(gains: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts in which some run of symbols gains more than entering and leaving costs, whatever states it takes; the others are clean."""
    best = gains.max(axis=1)
    out = []
    for i in np.flatnonzero(np.add.reduceat(np.append(np.maximum(best, 0), 0), np.minimum(bounds[:-1], len(best))) > -ENTER).tolist():
        run = np.concatenate([[0], np.cumsum(best[bounds[i] : bounds[i + 1]], dtype=float)])
        if len(run) > 1 and (run - np.minimum.accumulate(run)).max() > -ENTER:
            out.append(i)
    return np.array(out, np.int64)


def _parts(gains: np.ndarray) -> list[tuple[int, int]]:
    """The runs (begin, end) outside which the likeliest states are clean: of the symbols within some interval that gains more than entering costs, whatever states it takes."""
    sums = np.concatenate([[0], np.cumsum(gains.max(axis=1), dtype=float)])
    inside = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1]) > -ENTER
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
    return list(zip(edges[::2], edges[1::2]))


def viterbi(gains: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of several sequences of gains: 0 is clean, k the state of column k - 1."""
    out = [np.zeros(len(g), np.int64) for g in gains]
    parts = [(i, a, b) for i, g in enumerate(gains) if len(g) for a, b in _parts(g)]
    for (i, a, b), states in zip(parts, _decoded([gains[i][a:b] for i, a, b in parts])):
        out[i][a:b] = states
    return out


def _decoded(gains: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of sequences that begin and end beside clean symbols."""
    order = sorted(range(len(gains)), key=lambda i: -len(gains[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(gains)
    while order:
        most = max(1, 3_000_000 // (max(len(gains[order[0]]), 1) * gains[0].shape[1]))
        part, order = order[:most], order[most:]
        steps, states = len(gains[part[0]]), gains[0].shape[1]
        g = np.zeros((steps, len(part), states), np.float32)
        for j, i in enumerate(part):
            g[: len(gains[i]), j] = gains[i]
        clean = np.zeros(len(part), np.float32)
        other = np.full((len(part), states), -1e9, np.float32)
        came = np.zeros((steps, len(part), states), np.uint8)  # 0 stays, 1 from clean, 2 from the best other state
        left = np.zeros((steps, len(part)), bool)
        top = np.zeros((steps, len(part)), np.uint8)
        every = np.arange(len(part))
        lengths = np.array([len(gains[i]) for i in part])
        open_ = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()  # sequences longer than t, which come first
        for t, n in enumerate(open_):
            o = other[:n]
            j = o.argmax(axis=1)
            ended = o[every[:n], j] + LEAVE
            top[t, :n] = j
            leave = ended > clean[:n]
            left[t, :n] = leave
            np.maximum(clean[:n], ended, out=clean[:n])
            into = (clean[:n] + ENTER)[:, None]
            came[t, :n] = (into > o) * (1 + leave)[:, None]
            np.maximum(o, into, out=o)
            o += g[t, :n]
        j = other.argmax(axis=1)
        ends = np.where(other[every, j] + LEAVE > clean, j + 1, 0).tolist()
        for j, (i, now) in enumerate(zip(part, ends)):
            n = len(gains[i])
            back = list(zip(came[:n, j].tolist(), left[:n, j].tolist(), top[:n, j].tolist()))
            labels = [0] * n
            for t in range(n - 1, -1, -1):
                labels[t] = now
                how, leaves, best = back[t]
                if not now:
                    now = best + 1 if leaves else 0
                elif how[now - 1]:
                    now = best + 1 if how[now - 1] == 2 else 0
            out[i] = np.array(labels, np.int64)
    return out


def label(model: Model, texts: list[str]) -> tuple[Symbols, np.ndarray]:
    """The texts' symbols and their states.  Most clean texts are known by bounds of their gains already."""
    s = Symbols(texts)
    labels = np.zeros(len(s.codes), np.int64)
    if len(s.codes):
        bounds = np.searchsorted(s.places, s.begins)
        some = _worth_decoding(model.bounds(s)[:, None], bounds)
        if len(some):
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some.tolist()])
            gains = model.gains(s.only(at))
            within = np.concatenate([[0], np.cumsum(bounds[some + 1] - bounds[some])])
            worth = _worth_decoding(gains, within)
            for i, x in zip(worth.tolist(), viterbi([gains[within[i] : within[i + 1]] for i in worth.tolist()]) if len(worth) else []):
                labels[bounds[some[i]] : bounds[some[i] + 1]] = x
    return s, labels


def _leads() -> dict[str, list[str]]:
    """The characters that the first byte above ASCII of any UTF-8 may be read as, with the charsets it is then read in."""
    heads = [bytes([a, *more]) for a in range(0xC2, 0xF5) for more in ((), *((b,) for b in range(0x80, 0xC0)))]
    out: dict[str, list[str]] = {}
    for steps in PAIRS.values():
        true, read = steps[-1]
        if true == "utf-8" and len(steps) == 1:
            chars = {chr(c) for c, b in _WRITE[read].items() if 0xC2 <= b <= 0xF4} if read in _WRITE else {h.decode(read, "ignore") for h in heads}
            for c in chars:
                if len(c) == 1:
                    out.setdefault(c, []).append(read)
    return out


_HIGH = re.compile(r"[^\x00-\x7f]")
_LEADS = _leads()


def surely_garbled(text: str) -> bool:
    """Whether the text holds what only wrong decoding leaves, or a line that is UTF-8 once more when encoded as it was read."""
    text = _QUOTED.sub("", text)
    if "�" in text or "锟斤拷" in text or _CONTROL.search(text):
        return True
    for line in text.split("\n"):
        reads = _LEADS.get(m[0], ()) if (m := _HIGH.search(line)) else ()
        if reads and len(line) - len(line.encode("ascii", "ignore")) > 1:
            for read in reads:
                try:
                    _encode(line, read, "strict").decode("utf-8")
                    return True
                except UnicodeError:
                    pass
    return False


#: Every letter of latin-1 within, before and after a word, so that each state knows what becomes of rare ones.
_LETTERS = " ".join(f"e{chr(c)}n {chr(c)}n e{chr(c)}" for c in range(0xC0, 0x100) if chr(c).isalpha())


#: An ASCII run between other characters: its first two characters and its last one are all that neighbours see, garbled or not.
_RUN = re.compile(r"([\x00-\x7f]{2})[\x00-\x7f]+(?=[\x00-\x7f])")


def _counted(texts: list[str]) -> list[Counts]:
    """Counts of the texts as they are, without quotations, and of what each garbled state makes of them."""
    s = Symbols(texts)
    short = _RUN.sub(r"\1", "\n".join(texts))
    return [Counts.of(s, ~s.quoted), *(Counts.of(Symbols([garble(short, k)], quotes=False)) for k in PAIRS)]


def _marks(model: Model, texts: list[str]) -> list[int]:
    """Which of the texts the model finds garbled."""
    s, labels = label(model, texts)
    return [i for i in np.unique(s.text[labels > 0]).tolist() if checked(model, texts[i], *_of(s, labels, i))]


_PARTS = "state int, keys binary, n binary, after_keys binary, after_n binary"


def _to_rows(counts: list[Counts]) -> pa.RecordBatch:
    columns = [[x.astype(np.int64).tobytes() for c in counts for x in (pair(c),)] for pair in (lambda c: c.before[0], lambda c: c.before[1], lambda c: c.after[0], lambda c: c.after[1])]
    return pa.record_batch([pa.array(range(len(counts)), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["state", "keys", "n", "after_keys", "after_n"])


def _from_row(r: dict) -> Counts:
    x = {k: np.frombuffer(v, np.int64) for k, v in r.items() if k != "state"}
    return Counts((x["keys"], x["n"]), (x["after_keys"], x["after_n"]))


def _counter(shared):
    """Counts of this task's texts: of those not surely garbled or, when there are models, of those that the last one is the first to mark."""

    def work(batches):
        models = shared.value
        total: list[list[Counts]] = []
        for _, texts in text_batches(batches, "text"):
            if models:
                texts = [texts[i] for i in _marks(models[-1], texts)]
            base = [t for t in texts if not surely_garbled(t)]
            for m in models[:-1]:
                marked = set(_marks(m, base))
                base = [t for i, t in enumerate(base) if i not in marked]
            if base:
                total.append(_counted(base))
            if len(total) > 15:
                total = [[Counts.merged(list(x)) for x in zip(*total)]]
        if total:
            yield _to_rows([Counts.merged(list(x)) for x in zip(*total)])

    return work


def _merge_counts(batches):
    total: dict[int, Counts] = {}
    for batch in batches:
        for r in batch.to_pylist():
            c = _from_row(r)
            total[r["state"]] = Counts.merged([total[r["state"]], c]) if r["state"] in total else c
    for k, c in total.items():
        yield _to_rows([c]).set_column(0, "state", pa.array([k], pa.int32()))


def _counts(texts: DataFrame, models: list[Model]) -> list[Counts]:
    """Counts over all texts, for the clean state and each garbled one; at most characters times kinds of them come to the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(models)
    rows = texts.mapInArrow(_counter(shared), _PARTS)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = [Counts(none, none) for _ in range(len(PAIRS) + 1)]
    for r in rows.repartition(len(out), "state").mapInArrow(_merge_counts, _PARTS).toLocalIterator():
        out[r["state"]] = _from_row(r.asDict())
    shared.destroy()
    return out


def learn(texts: DataFrame, passes: int = PASSES) -> Model:
    """A model from all texts (text), of which most are clean.

    Everything is counted once; later passes take out the counts of the texts that the model so far marks.
    """
    letters = [Counts.of(Symbols([garble(_LETTERS, k)])) for k in PAIRS]
    models: list[Model] = []
    counts: list[Counts] = []
    for _ in range(passes):
        new = _counts(texts, models)
        counts = [a.without(b) for a, b in zip(counts, new)] if counts else new
        models.append(Model(counts[0], [Counts.merged([c, x]) for c, x in zip(counts[1:], letters)]))
    return models[-1]


def _of(s: Symbols, labels: np.ndarray, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and states of one text's symbols."""
    a, b = np.searchsorted(s.text, [text, text + 1])
    return s.places[a:b] - s.begins[text], labels[a:b]


def proven(span: str, restored: str, whole: bool, state: str) -> bool:
    """Whether a lossless inverse alone shows that the span was garbled.

    Only UTF-8 that was read otherwise, and GB2312 pairs read as latin-1, hardly ever arise by
    chance; any Cyrillic word is valid GBK, and any byte a character of cp850.
    """
    if not whole or restored == span:
        return False
    if state == "gbk>latin-1":
        try:
            return len(_encode(span, "latin-1", "strict").decode("gb2312")) > 1
        except UnicodeError:
            return False
    return all(true == "utf-8" for true, _ in PAIRS[state])


def checked(model: Model, text: str, places: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """The text's spans without those that cannot be what their state makes.

    What is restored has to be proven by a lossless inverse or to consist, by more than half, of
    characters known from clean text; states that lose most characters have to have left a sign of it.
    """
    out = []
    for begin, end, state in spans(text, places, labels):
        if ("gbk", "utf-8") in PAIRS[state] or state == "latin-1>utf-8":
            good = any(c in "�锟斤拷" for c in text[begin:end])
        else:
            restored, whole, to = undo(text, begin, end, state)
            high = [ord(c) for c in restored if c > "\x7f" and c != "�"]
            good = proven(text[begin:to], restored, whole, state) or 2 * np.isin(high, model.clean).sum() > len(high)
        if good:
            out.append((begin, end, state))
    return out


def spans(text: str, places: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(begin, end, state) of each run of one garbled state; ASCII between symbols of a run belongs to it."""
    names = list(PAIRS)
    out = []
    edges = np.flatnonzero(np.diff(labels)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(labels)]):
        if b > a and labels[a]:
            out.append((int(places[a]), int(places[b - 1]) + 1, names[labels[a] - 1]))
    return out


def undo(text: str, begin: int, end: int, state: str) -> tuple[str, bool, int]:
    """A span restored, whether nothing was lost, and where it ends: the second byte of a character may have been read as ASCII."""
    best, whole = restore(text[begin:end], state)
    if not whole and end < len(text) and "@" <= text[end] <= "~":
        more, fine = restore(text[begin : end + 1], state)
        if fine:
            return more, True, end + 1
    return best, whole, end


def repair(text: str, found: Iterable[tuple[int, int, str]]) -> tuple[str, bool]:
    """The text with its spans restored, and whether nothing was lost."""
    out, at, whole = [], 0, True
    for begin, end, state in found:
        begin = max(begin, at)
        fixed, ok, end = undo(text, begin, end, state)
        out += [text[at:begin], fixed]
        at, whole = end, whole and ok
    return "".join([*out, text[at:]]), whole


def _worker(shared):
    def work(batches):
        for batch, texts in text_batches(batches, "text"):
            texts = [t or "" for t in texts]
            s, labels = label(shared.value, texts)
            rows, found, fixed, whole = [], [], [], []
            marked = np.unique(s.text[labels > 0])
            for i in marked.tolist():
                x = checked(shared.value, texts[i], *_of(s, labels, i))
                if not x:
                    continue
                text, ok = repair(texts[i], x)
                rows.append(i)
                found.append([{"begin": p, "end": q, "pair": k} for p, q, k in x])
                fixed.append(text)
                whole.append(ok)
            if rows:
                yield pa.record_batch([batch.column("src").take(pa.array(rows)), batch.column("ref").take(pa.array(rows)), pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("pair", pa.string())]))), pa.array(fixed, pa.string()), pa.array(whole)], ["src", "ref", "spans", "restored", "whole"])

    return work


def garbled(texts: DataFrame) -> DataFrame:
    """(src, ref, spans, restored, whole) for every text of (src, ref, text) that was decoded wrongly in part.

    spans have begin, end and the pair of charsets; restored is the text with every span's transform
    undone, whole says whether nothing was lost.  Characters between backticks on one line are
    quotations and never garbled.  Null and empty texts, and texts in ASCII, have no row; repeated
    rows have a row each; an empty table gives an empty result.
    """
    texts = texts.select("src", "ref", "text")
    known = texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    model = learn(known.select("text"))
    return known.mapInArrow(_worker(texts.sparkSession.sparkContext.broadcast(model)), "src string, ref string, spans array<struct<begin: long, end: long, pair: string>>, restored string, whole boolean")
