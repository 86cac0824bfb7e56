"""Language-model scoring: Katz backoff over word n-grams, Good-Turing discounts, exact normalisation.

With h a history of the last words of a text, h' the same without its oldest word, and c training counts,

    P(x | h) = d(c(h, x)) c(h, x) / c(h)        where (h, x) was seen,
    P(x | h) = alpha(h) P(x | h')               where only h was seen,
    P(x | h) = P(x | h')                        where not even h was seen,
    alpha(h) = (1 - sum over seen x of d c(h, x) / c(h)) / (1 - sum over seen x of P(x | h')),

down to single words, whose discounts leave a share for all unknown words together. Every distribution
sums to one. d is Katz's discount after Good and Turing for counts up to a cut: the largest cut up to
CUT for which all of them lie between 0 and 1 (`discounts`). Of three words, those seen once only are
left out, as Katz did: to the model they are unseen (LEAST), so their share goes to the shorter
history. A history of which every count is above the cut would keep nothing back, so one more is added
to its count. Before a text's first word stand START words; its end is a word.

Orders are counted one after another (`level`), each in a table partitioned by hash of the history:

1. Texts are read once, into chunks of CHUNK tokens: their words as numbers of the chunk's own list.
2. For an order, a chunk asks each group of n-grams for those that it holds, with its training counts.
   The group adds up the counts of all chunks and the sums that each history's weight follows from, and
   answers every chunk with the counts of what it asked for, and the sums where it was not seen.
3. With the counts of one order a chunk knows all that the next order's requests need.
4. With all answers a chunk evaluates the recursion for each of its tokens.

A chunk sends each n-gram once, however often it occurs, so a frequent n-gram has an entry a chunk. A
history of more than HOT tokens is dealt over several groups by the next word; its sums are added up
from them and broadcast (at most 2 N / HOT rows, and HOT is N / MOST_HOT at least). Words get
numbers by falling count, so that what is sent is short; nothing depends on which they are.

Defined results: a null or empty text is its end alone; a null doc_id counts as training; repeated
rows are learnt from and scored each; a text of more than CHUNK tokens is cut into pieces that know the
words before them; without training rows every count is 0 and every unknown word has probability
1; other columns are dropped, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .base import ROW, documents, dropped, groups_for, keyed_text, released, released_group, stored, text_bytes

ORDER = 3
#: Counts up to this are discounted where the counts of counts allow it.
CUT = 5
#: Training count from which an n-gram of each order is part of the model.
LEAST = {1: 1, 2: 1, 3: 2}
#: Tokens of a chunk.
CHUNK = 1_000_000
#: Text bytes for each group of words and of n-grams.
WORD_BYTES, GROUP_BYTES = 32 << 20, 6 << 20
#: Tokens from which a history is dealt over groups, and the least share of all tokens that this is.
HOT, MOST_HOT = 1_000_000, 50_000
#: The text's end is a word that no text can hold.
END = np.uint64(0x5E0FFACE5E0FFACE)
#: Bits of a word's number within a chunk; 0 stands for START.
BITS = 21
MASK = (1 << BITS) - 1

ROWS = "kind string, group int, chunk long, payload binary"
STATE, ASK, ANSWER, TOTALS, SPREAD, TABLE = "state", "ask", "answer", "totals", "spread", "table"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole or real numbers as one compressed string: shortest width, bytes in planes."""
    parts = []
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max(initial=0))
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        parts += [np.array([len(a)], np.int64).tobytes(), a.dtype.str.encode().ljust(4), H.planes(a)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(raw: bytes) -> list[np.ndarray]:
    """The arrays of `squeeze`: whole numbers as int64, or uint64 where they need it."""
    b, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(b):
        n, kind = int(np.frombuffer(b, np.int64, 1, at)[0]), np.dtype(b[at + 8 : at + 12].decode().strip())
        a = H.unplanes(b[at + 12 : at + 12 + n * kind.itemsize], kind) if n else np.zeros(0, kind)
        out.append(a if kind.kind == "f" or kind.itemsize == 8 else a.astype(np.int64))
        at += 12 + n * kind.itemsize
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "group", "chunk", "payload"])


def _runs(key: np.ndarray) -> np.ndarray:
    """First places of runs of equal values, and the length."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)


def _steps(a: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Differences within runs (a ascends there), first values whole; run: as from `_runs`."""
    out = np.diff(a, prepend=0)
    out[run[:-1]] = a[run[:-1]]
    return out


def _sums(steps: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The reverse of `_steps`."""
    out = np.cumsum(steps)
    first = run[:-1]
    return out - np.repeat(out[first] - steps[first], np.diff(run))


def discounts(n: list[float]) -> tuple[int, np.ndarray]:
    """(cut, discount of each count up to CUT) from n, the numbers of n-grams of count 1 to CUT + 1.
    Counts above the cut are left as they are."""
    for cut in range(CUT, 0, -1):
        if min(n[: cut + 1]) <= 0:
            continue
        common = (cut + 1) * n[cut] / n[0]
        if common >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, cut + 1)]
        if all(0 < x < 1 for x in d):
            return cut, np.array([*d, *[1.0] * (CUT - cut)])
    return 0, np.ones(CUT)


@dataclass
class Order:
    """What is known of an order once it is counted."""

    counts: list[float]
    total: int = 0
    types: int = 0
    #: Sums of the histories dealt over groups, by the history's words.
    spread: dict[tuple, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.cut, self.d = discounts(self.counts)

    def reduced(self, c: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.where(c <= CUT, self.d[np.clip(c, 1, CUT) - 1], 1.0) * c

    def kept(self, sums: np.ndarray) -> np.ndarray:
        """Discounted counts of a history from its sums: types of count 1 to CUT, larger counts."""
        return sums[:, :CUT] @ (self.d * np.arange(1, CUT + 1)) + sums[:, CUT]

    def full(self, sums: np.ndarray) -> np.ndarray:
        """Whether nothing of a history is discounted."""
        return sums[:, : self.cut].sum(axis=1) == 0


@dataclass
class Model:
    words: int
    groups: int
    order: int
    least_hot: int = HOT
    orders: list[Order] = field(default_factory=list)

    @property
    def tokens(self) -> int:
        return self.orders[0].total

    @property
    def hot(self) -> int:
        return max(self.least_hot, self.tokens // MOST_HOT)


def chunks(docs: DataFrame, words: int, tokens: int = CHUNK) -> DataFrame:
    """State rows, one a chunk, and the chunk's requests for single words. docs: row id, doc_id, text, held_out."""

    @released
    def run(batches):
        pieces: list[tuple] = []
        held = 0

        def flush():
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            h = np.concatenate([p[4] for p in pieces])
            size, skip, train = (np.array([p[k] for p in pieces], np.int64) for k in (5, 6, 3))
            fresh = np.ones(len(h), bool)  # not before the piece
            start = np.cumsum(size) - size
            for k in (0, 1):
                fresh[start[skip > k] + k] = False
            u, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, np.repeat(train, size) * fresh, len(u)).astype(np.int64)
            group = (u % np.uint64(words)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            place = np.empty(len(u), np.int64)
            place[order] = np.arange(len(u))
            cut = np.searchsorted(group[order], np.arange(words + 1))
            rows = [(ASK, g, chunk, squeeze(np.diff(u[order[s:e]], prepend=np.uint64(0)), n[order[s:e]])) for g, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if s < e]
            ids = np.array([p[1] or 0 for p in pieces], np.int64)
            none = np.array([p[1] is None for p in pieces], np.int64)
            row = np.array([p[0] for p in pieces], np.int64)
            state = squeeze(place[at], size, skip, train, row.view(np.uint64), ids.view(np.uint64), none, np.array([len(u)]))
            return _rows([(STATE, None, chunk, state), *rows])

        for b in batches:
            data, off = H.buffers(b.column("text"))
            row, doc, out_of = (b.column(c).to_pylist() for c in (ROW, "doc_id", "held_out"))
            for i, j, h, at in H.words(data, off, H.digests, block=H.WIDE):
                for k in range(i, j):
                    w = np.append(h[at[k - i] : at[k - i + 1]], END)
                    for s in range(0, len(w), tokens):
                        skip = min(s, 2)
                        part = w[s - skip : s + tokens]
                        pieces.append((row[k], doc[k], None, not out_of[k], part, len(part), skip))
                        held += len(part)
                        if held >= tokens:
                            yield flush()
                            pieces, held = [], 0
        if pieces:
            yield flush()

    return docs.select(ROW, "doc_id", "held_out", "text").mapInArrow(run, ROWS)


def count_words(groups: int, keep: bool = False):
    """A group of words: adds up the chunks' counts and answers with each word's number and count."""

    @released_group
    def run(t: pa.Table) -> pa.Table:
        g = t.column("group")[0].as_py()
        asked = [expand(p) for p in t.column("payload").to_pylist()]
        words = [np.cumsum(a[0].astype(np.uint64), dtype=np.uint64) for a in asked]
        u, at = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(at, np.concatenate([a[1] for a in asked]), len(u)).astype(np.int64)
        number = np.empty(len(u), np.int64)
        number[np.argsort(-n, kind="stable")] = np.arange(len(u)) * groups + g + 1
        number[n == 0] = 0
        cut = np.cumsum([0, *map(len, words)])
        rows = [(ANSWER, g, c, squeeze(number[at[s:e]], n[at[s:e]])) for c, s, e in zip(t.column("chunk").to_pylist(), cut[:-1], cut[1:], strict=True)]
        end = int(n[u == END].sum())
        by_count = [int((n == r).sum()) for r in range(1, CUT + 2)]
        rows.append((TOTALS, g, None, np.array([*by_count, n.sum(), (n > 0).sum(), end], np.int64).tobytes()))
        if keep:
            rows.append((TABLE, g, None, squeeze(u[n > 0], number[n > 0], n[n > 0])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _kept(method):
    """Keeps a method's value for each order as long as the object lives."""

    @wraps(method)
    def get(self, k):
        if (method.__name__, k) not in self.kept:
            self.kept[method.__name__, k] = method(self, k)
        return self.kept[method.__name__, k]

    return get


class Chunk:
    """A chunk with the answers that it has so far; places of n-grams are those of its own lists."""

    def __init__(self, t: pa.Table, model: Model, known: int):
        self.m, self.kept = model, {}
        kind, group, payload, level = (t.column(c).to_pylist() for c in ("kind", "group", "payload", "level"))
        state = expand(payload[kind.index(STATE)])
        token, self.size, self.skip, self.train, row, ids, none, many = state
        self.row, self.doc = row.view(np.int64), [None if z else int(x) for x, z in zip(ids.view(np.int64), none, strict=True)]
        self.starts = model.orders[0].starts if model.orders else 0
        answer = {(lv, g): p for k, lv, g, p in zip(kind, level, group, payload, strict=True) if k == ANSWER}
        # Words in order of their numbers; 0 is START.
        got = [expand(answer[1, g]) for g in range(model.words) if (1, g) in answer]
        number, count = (np.concatenate([x[k] for x in got]) for k in (0, 1))
        order = np.argsort(number, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        self.number, self.count = np.r_[0, number[order]], np.r_[0, count[order]]
        self.token = place[token].astype(np.int32)
        first = np.cumsum(self.size) - self.size
        before = lambda a: self._shifted(a, first)
        self.fresh = np.ones(len(token), bool)
        for k in (0, 1):
            self.fresh[first[self.skip > k] + k] = False
        weight = np.repeat(self.train, self.size).astype(bool) & self.fresh
        # Order k: its n-grams as keys (last word of the history, the word before that, ..., the word).
        # lower: the shorter n-gram at its end; history: the n-gram before its word (of no meaning after START).
        self.keys, self.at, self.n = [None, None], [None, self.token], [None, None]
        self.lower, self.history = [None, None], [None, None]
        key, back = self.token.astype(np.uint64), self.token
        histories = None
        for k in range(2, known + 2 if known < model.order else model.order + 1):
            back = before(back)
            histories = back.astype(np.uint64) if histories is None else (histories << np.uint64(BITS)) | back.astype(np.uint64)
            u, at = np.unique((histories << np.uint64(BITS)) | key, return_inverse=True)
            at = at.astype(np.int32)
            self.keys.append(u)
            self.at.append(at)
            self.n.append(np.bincount(at[weight], minlength=len(u)).astype(np.int32))
            for places, value in ((self.lower, self.at[k - 1]), (self.history, before(self.at[k - 1]))):
                places.append(np.empty(len(u), np.int32))
                places[k][at] = value
        self.counts, self.least, self.sums = [None, self.count], [None, None], [None, None]
        for k in range(2, known + 1):
            self._read(k, answer)

    @staticmethod
    def _shifted(a: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        out[1:] = a[:-1]
        out[first] = 0
        return out

    def words_of(self, k: int) -> list[np.ndarray]:
        """Places of an order's words: the history's last, the one before, ..., and the word."""
        return [(self.keys[k] >> np.uint64(BITS * (k - 1 - i))).astype(np.int64) & MASK for i in range(k)]

    @_kept
    def history_count(self, k: int) -> np.ndarray:
        """c(h) of an order's n-grams."""
        return np.where(self.words_of(k)[0] == 0, self.starts, self.counts[k - 1][self.history[k]])

    @_kept
    def asked(self, k: int):
        """(n-grams asked for, by group; first places of the groups; groups; hot ones; whose answer each
        one takes) of an order. An n-gram that cannot be in the model, since its history or
        the shorter n-gram is too rare, is asked for as the word 0, once a history."""
        w, size, low = self.words_of(k), self.history_count(k), self.lower[k]
        there = self.counts[k - 1][low] >= LEAST[k]
        x = np.where(there, self.number[w[-1]], 0)
        hot = size > self.m.hot
        i = np.flatnonzero(size >= LEAST[k])
        whose = np.arange(len(x))
        none = i[~there[i]]
        if len(none):
            name = self.keys[k][none] >> np.uint64(BITS)
            first = none[np.r_[True, name[1:] != name[:-1]]]
            whose[none] = np.repeat(first, np.diff(_runs(name)))
            i = i[whose[i] == i]
        h = np.zeros(len(i), np.uint64)
        for word in w[:-1]:
            h = H.mix(h * np.uint64(H.BASE) + self.number[word[i]].astype(np.uint64) + np.uint64(k))
        if hot[i].any():
            at = hot[i]
            over = -(-size[i][at] // self.m.hot)
            h[at] = H.mix(h[at] + np.uint64(1) + H.mix(x[i][at].astype(np.uint64)) % over.astype(np.uint64))
        group = h % np.uint64(self.m.groups)
        order = np.argsort(group.astype(np.uint16) if self.m.groups < 1 << 16 else group, kind="stable")
        i, group = i[order], group[order]
        cut = _runs(group)
        return i, cut, group[cut[:-1]], hot, whose, w, x

    def ask(self, k: int) -> list[tuple]:
        """Requests of order k: words of the history (numbers), the word (0: not seen after the shorter
        history), training count, count and divisor in the order below, whether the history is hot."""
        i, cut, groups, hot, whose, w, x = self.asked(k)
        low = self.lower[k]
        below = self.counts[k - 1][low]
        below[x == 0] = 0
        over = np.full(len(x), self.m.tokens + int(self._full_words())) if k == 2 else self._divisor(k - 1)[low]
        rows = []
        for s, e, g in zip(cut[:-1], cut[1:], groups, strict=True):
            j = i[s:e]
            last = self.number[w[0][j]]
            run = _runs(last)
            # The divisor follows from the history's last word, where the shorter n-gram was seen.
            first = np.maximum.reduceat(np.where(below[j] > 0, over[j], 0), run[:-1]) if k == 3 else np.zeros(0, np.int64) if k == 2 else over[j]
            rows.append((ASK, int(g), squeeze(np.diff(last, prepend=0), *(_steps(self.number[y[j]], run) for y in w[1:-1]), x[j], np.where(x[j] > 0, self.n[k][j], 0), below[j], hot[j].astype(np.uint8), first)))
        # Of those not asked for, what was seen was seen once.
        alone = np.ones(len(x), bool)
        alone[i] = x[i] == 0
        rows.append((TOTALS, None, np.array([(self.n[k][alone] > 0).sum(), *[0] * (CUT + 3)], np.int64).tobytes()))
        return rows

    def _full_words(self) -> bool:
        first = self.m.orders[0]
        return sum(first.counts[: first.cut]) == 0

    def _read(self, k: int, answer: dict) -> None:
        i, cut, groups, hot, whose, w, _ = self.asked(k)
        size = len(self.keys[k])
        count, least, sums = np.zeros(size, np.int64), np.zeros(size, np.uint8), np.zeros((size, CUT + 2))
        for s, e, g in zip(cut[:-1], cut[1:], groups, strict=True):
            code, *rest = expand(answer[k, int(g)])
            j = i[s:e]
            count[j], least[j] = code >> 3, code & 7
            none = j[code == 0]
            run = _runs(self.keys[k][none] >> np.uint64(BITS))
            sums[none] = np.repeat(np.stack(rest, 1), np.diff(run), axis=0)
        sums, least = sums[whose], least[whose]
        if hot.any():  # all of a hot history
            spread = self.m.orders[k - 1].spread
            j = np.flatnonzero(hot)
            names = np.stack([self.number[y[j]] for y in w[:-1]], 1)
            of, at = np.unique(names, axis=0, return_inverse=True)
            whole = np.stack([spread.get(tuple(map(int, h)), np.zeros(CUT + 2)) for h in of])
            sums[j] = whole[at.ravel()]
            none = np.where(whole[:, :CUT] > 0, np.arange(1, CUT + 1), CUT + 1).min(axis=1)
            least[j] = none[at.ravel()]
        self.counts.append(count)
        self.least.append(least)
        self.sums.append(sums)

    @_kept
    def _divisor(self, k: int) -> np.ndarray:
        """c(h) of an order's n-grams, one more where nothing of the history is discounted."""
        o = self.m.orders[k - 1]
        seen = self.counts[k] > 0
        full = np.where(seen, self.least[k] > o.cut, o.full(self.sums[k]))
        return self.history_count(k) + full

    def score(self) -> np.ndarray:
        """log10 P of each token, by the recursion."""
        one = self.m.orders[0]
        divisor = one.total + int(self._full_words())
        unknown = 1 - (one.total - sum((1 - d) * r * n for r, (d, n) in enumerate(zip(one.d, one.counts, strict=False), 1))) / divisor if divisor else 1.0
        p = np.where(self.count > 0, one.reduced(self.count) / max(divisor, 1), unknown if one.total else 1.0)
        for k in range(2, self.m.order + 1):
            o = self.m.orders[k - 1]
            size, over = self.history_count(k), self._divisor(k)
            below = p[self.lower[k]]
            s = self.sums[k]
            alpha = (over - o.kept(s)) / np.maximum(over, 1) / (1 - s[:, CUT + 1])
            p = np.where(self.counts[k] > 0, o.reduced(self.counts[k]) / np.maximum(over, 1), np.where(size > 0, alpha, 1.0) * below)
        return np.log10(p)[self.at[self.m.order]]


def _by_history(history: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The order by history and word."""
    bits = [int(a.max(initial=0)).bit_length() for a in (*history, x)]
    if sum(bits[:-1]) > 63 or len(x).bit_length() + bits[-1] > 63:
        return np.lexsort((x, *history[::-1]))
    key = history[0]
    for h, b in zip(history[1:], bits[1:-1], strict=True):
        key = (key << b) | h
    if sum(bits) > 63:
        key = np.unique(key, return_inverse=True)[1]
    return np.argsort((key << bits[-1]) | x)


def count(k: int, below: Order, keep: bool = False):
    """A group of n-grams of order k: adds up the chunks' counts, sums up its histories and answers."""

    @released_group
    def run(t: pa.Table) -> pa.Table:
        g = t.column("group")[0].as_py()
        own = t.filter(pc.equal(t.column("kind"), TOTALS))
        rows = [(TOTALS, g, None, p) for p in own.column("payload").to_pylist()]
        t = t.filter(pc.equal(t.column("kind"), ASK))
        if not len(t):
            return pa.Table.from_batches([_rows(rows)])
        asked = [expand(p) for p in t.column("payload").to_pylist()]
        t = t.select(["chunk"])
        for a in asked:
            a[0] = np.cumsum(a[0])
            if k == 3:
                run = _runs(a[0])
                a[1], a[-1] = _sums(a[1], run), np.repeat(a[-1], np.diff(run))
        size = [len(a[0]) for a in asked]
        columns = [np.concatenate([a[c] for a in asked]) for c in range(len(asked[0]) - 1)]
        history, (x, n, low, hot) = columns[: k - 1], columns[k - 1 :]
        over = np.concatenate([a[-1] for a in asked]) if k > 2 else None
        del asked, columns
        order = _by_history(history, x)
        history = [h[order] for h in history]
        x, n, low, hot = x[order], n[order], low[order], hot[order]
        new_history = np.zeros(len(x), bool)
        new_history[:1] = True
        for h in history:
            new_history[1:] |= h[1:] != h[:-1]
        new = new_history.copy()
        new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        times = np.add.reduceat(n, first)
        whose = np.cumsum(new_history)[first] - 1  # history of each distinct n-gram
        many = int(whose[-1]) + 1
        seen = times >= LEAST[k]
        # The divisor may be missing where an entry's shorter n-gram was not seen; then it adds nothing.
        share = below.reduced(low[first]) / (np.maximum(np.maximum.reduceat(over[order], first), 1) if k > 2 else max(1, below.divisor))
        sums = np.zeros((many, CUT + 2))
        for r in range(1, CUT + 1):
            sums[:, r - 1] = np.bincount(whose, seen & (times == r), many)
        sums[:, CUT] = np.bincount(whose, np.where(times > CUT, times, 0), many)
        sums[:, CUT + 1] = np.bincount(whose, np.where(seen, share, 0), many)
        least = np.where(sums[:, :CUT] > 0, np.arange(1, CUT + 1), CUT + 1).min(axis=1)
        code = np.empty(len(x), np.int64)
        code[order] = np.where(seen, times * 8 + least[whose], 0)[kind]
        unseen = np.empty(len(x), np.int64)
        unseen[order] = whose[kind]
        cut = np.cumsum([0, *size])
        for c, s, e in zip(t.column("chunk").to_pylist(), cut[:-1], cut[1:], strict=True):
            # Sums of the histories of what was not seen, each once, in the order of the request.
            z = unseen[s:e][code[s:e] == 0]
            z = sums[z[_runs(z)[:-1]]]
            rows.append((ANSWER, g, c, squeeze(code[s:e], *(z[:, j].astype(np.int64) for j in range(CUT + 1)), z[:, CUT + 1])))
        by_count = [int((times == r).sum()) for r in range(1, CUT + 2)]
        rows.append((TOTALS, g, None, np.array([*by_count, times.sum(), seen.sum(), 0], np.int64).tobytes()))
        i = np.flatnonzero(new_history)
        i = i[hot[i] > 0]
        if len(i):
            of = whose[kind[i]]
            rows.append((SPREAD, g, None, squeeze(*(h[i] for h in history), *(sums[of, j] for j in range(CUT + 2)))))
        if keep:
            f = first[seen]
            rows.append((TABLE, g, None, squeeze(*(h[f] for h in history), x[f], times[seen])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def level(state: DataFrame, answers: list[DataFrame], model: Model, k: int, keep: bool = False) -> DataFrame:
    """The stored table of order k: answers to the chunks, totals, hot histories and the n-grams."""
    at = state.sparkSession.sparkContext.broadcast(model)
    below = model.orders[-1]

    @released_group
    def ask(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        return pa.Table.from_batches([_rows([(kind, g, chunk, p) for kind, g, p in Chunk(t, at.value, k - 1).ask(k)])])

    add = count(k, below, keep)
    asked = _together(state, answers).groupBy("chunk").applyInArrow(lambda t: ask(t), ROWS)
    # A chunk's own totals are a group's rows like any other.
    dealt = asked.withColumn("group", F.coalesce("group", F.pmod("chunk", F.lit(model.groups)).cast("int")))
    return stored(dealt.groupBy("group").applyInArrow(lambda t: add(t), ROWS), f"order{k}")


def _together(state: DataFrame, answers: list[DataFrame]) -> DataFrame:
    out = state.withColumn("level", F.lit(0))
    for k, a in enumerate(answers, 1):
        out = out.unionByName(a.where(F.col("kind") == ANSWER).withColumn("level", F.lit(k)))
    return out


def _order(table: DataFrame, k: int) -> Order:
    """Adds up the totals (a row of a few numbers a group) and the sums of hot histories."""
    total = np.zeros(CUT + 4, np.int64)
    spread: dict[tuple, np.ndarray] = {}
    for r in table.where(F.col("kind").isin(TOTALS, SPREAD)).select("kind", "payload").toLocalIterator():
        if r["kind"] == TOTALS:
            total += np.frombuffer(bytes(r["payload"]), np.int64)
        else:
            columns = expand(bytes(r["payload"]))
            for row in zip(*(c.tolist() for c in columns), strict=True):
                name = tuple(int(x) for x in row[: k - 1])
                spread[name] = spread.get(name, 0) + np.array(row[k - 1 :])
    o = Order([float(x) for x in total[: CUT + 1]], int(total[CUT + 1]), int(total[CUT + 2]), spread)
    o.starts = int(total[CUT + 3])
    o.divisor = o.total + int(sum(o.counts[: o.cut]) == 0)
    return o


def score(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK, hot: int = HOT, tables: str | None = None) -> DataFrame:
    """docs: row id, doc_id, text, held_out (false: learnt from). Returns a row each with token counts,
    base_score and score. The tables of the orders are deleted once the result is stored; their n-grams
    are kept in the folder `tables` where it is given, for `ngrams`."""
    if order * BITS > 63:
        raise ValueError("an order of 3 at most")
    size = text_bytes(docs)
    model = Model(groups_for(size, WORD_BYTES), groups_for(size, GROUP_BYTES), order, hot)
    all_chunks = stored(chunks(docs, model.words, chunk), "chunks", "kind")
    run = count_words(model.words, tables is not None)
    words = stored(all_chunks.where(F.col("kind") == ASK).groupBy("group").applyInArrow(lambda t: run(t), ROWS), "order1")
    dropped(all_chunks, "kind=ask")
    answers = [words]
    model.orders.append(_order(words, 1))
    state = all_chunks.where(F.col("kind") == STATE)
    for k in range(2, order + 1):
        answers.append(level(state, answers, model, k, tables is not None))
        model.orders.append(_order(answers[-1], k))
    at = docs.sparkSession.sparkContext.broadcast(model)
    names = [ROW, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    @released_group
    def evaluate(t: pa.Table) -> pa.Table:
        m = at.value
        c = Chunk(t, m, m.order)
        piece = np.repeat(np.arange(len(c.size)), c.size)
        add = lambda w: np.bincount(piece, np.where(c.fresh, w, 0), len(c.size))
        times = c.count[c.token]
        base = np.log10((times + 0.1) / (m.tokens + 0.1 * (m.orders[0].types + 1)))
        whole = [add(np.ones(len(piece))).astype(np.int64), add(times > 0).astype(np.int64), add(base), add(c.score())]
        return pa.table([pa.array(c.row), pa.array(c.doc, pa.int64()), pa.array(c.train == 0), *map(pa.array, whole)], names=names)

    per_piece = _together(state, answers).groupBy("chunk").applyInArrow(lambda t: evaluate(t), f"{ROW} long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    added = per_piece.groupBy(*names[:3]).agg(*(F.sum(c).alias(c) for c in names[3:]))
    out = stored(added.select(*names[:5], F.lit(model.tokens).cast("long").alias("train_tokens"), *names[5:]), "scores")
    for k, table in enumerate(answers, 1):
        if tables is not None:
            table.where(F.col("kind") == TABLE).select("group", "payload").write.parquet(f"{tables}/order={k}")
    for table in (all_chunks, *answers):
        dropped(table)
    return out


def ngrams(spark: SparkSession, tables: str, order: int) -> DataFrame:
    """A kept table of an order: words by hash, number and count (order 1), or numbers of the history's
    words, the last first, of the word, and count. A row each."""
    names = ["hash", "word", "n"] if order == 1 else [*(f"history{i}" for i in range(1, order)), "word", "n"]

    @released
    def run(batches):
        for b in batches:
            for p in b.column("payload").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in expand(p)], names)

    return spark.read.parquet(f"{tables}/order={order}").select("payload").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return score(keyed_text(documents(spark, sf_dir)).withColumn("held_out", held_out)).drop(ROW)
