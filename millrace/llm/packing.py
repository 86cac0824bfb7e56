"""Packing tokenized documents into sequences of at most WINDOW tokens.

1. Each document is tokenized once and cut at multiples of WINDOW; every piece's length, checksum
   and rank among the equal lengths of its part of the table are kept (`tokenize`), the ids are not.
2. The histogram of lengths (WINDOW numbers) goes to the driver. Shallow combinations of lengths
   that fill a window (singles, pairs, triples) are enumerated, their repeat counts solved by
   non-negative least squares against the histogram and rounded down, and what is left is packed
   greedily, longest first, into the best-fitting space (`plan`).
3. Ranks are counted through over the parts (a table of parts x lengths), and the piece of a
   length with rank r takes the r-th place that the plan has for that length.

Defined results: a null or empty text is its end token alone; repeated rows are packed each; a very long text
is cut into as many pieces as it needs, its ids made in one task;
no rows give no pieces; other columns are dropped, so none can clash.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections import defaultdict
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, keyed_text, released, ship, slices, stored, tokenizer_path

WINDOW = 2048
END = 1
#: Words whose ids a task keeps; beyond it the store is emptied and fills again.
KEEP = 100_000
SPECIAL = "<|endoftext|>"
#: Signs that often end a word.
SIGNS = ".,;:!?"


def _ranks(path: str):
    """The vocabulary of path as ranks, where the file beside it has them."""
    import public_tokenizers
    import tiktoken

    beside = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(beside):
        return None
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Ids of the byte-level vocabulary as little-endian uint32 bytes.

    The pattern that splits texts starts a new part at a space before a non-space, so where no
    two spaces meet the words between spaces are encoded apart and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.lib = Library.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

        self.ranks = _ranks(path)

    def forget(self) -> None:
        self.ids, self.tails = {}, {}

    def fast(self, texts: list[str]) -> list[bytes]:
        """The same ids from the same vocabulary as ranks, which tests compare; three times as fast on words."""
        if self.ranks is None:
            return self.library(texts)
        return [array("I", ids).tobytes() for ids in map(self.ranks.encode_ordinary, texts)]

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: set[str]) -> None:
        """Encodes words with a space in front. The pattern splits letters and digits from the signs
        after them, so signs at a word's end are looked up apart."""
        cut = {x: len(x.rstrip(SIGNS)) for x in missing}
        ends = {x: k for x, k in cut.items() if k < len(x) and k and x[k - 1].isalnum()}
        stems = {x[:k] for x, k in ends.items()} | (missing - ends.keys())
        stems = list(stems - self.ids.keys())
        tails = list({x[k:] for x, k in ends.items()} - self.tails.keys())
        self.ids.update(zip(stems, self.fast([" " + x for x in stems]), strict=True))
        self.tails.update(zip(tails, self.fast(tails), strict=True))
        self.ids.update((x, self.ids[x[:k]] + self.tails[x[k:]]) for x, k in ends.items())

    def batch(self, texts: list[str]) -> list[bytes]:
        plain = [bool(x) and "  " not in x and SPECIAL not in x and x[0] != " " and x[-1] != " " for x in texts]
        cut = [(" " + x).split(" ") if ok else None for x, ok in zip(texts, plain, strict=True)]
        if len(self.ids) > KEEP:
            self.forget()
        missing: set[str] = set()
        for p in filter(None, cut):
            missing.update(filterfalse(self.ids.__contains__, p[2:]))
        if missing:
            self.learn(missing)
        whole = iter(self.library([p[1] if ok else x for x, p, ok in zip(texts, cut, plain, strict=True)]))
        get = self.ids.__getitem__
        return [first + b"".join(map(get, p[2:])) if ok else first for first, p, ok in zip(whole, cut, plain, strict=True)]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def tokenize(df: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row per piece: where it stands, its checksum, and its rank among the pieces of its length
    in this part of the table."""
    tail = np.uint32(end).tobytes()

    @released
    def run(batches):
        t, part, seen = tokenizer(path), TaskContext.get().partitionId(), defaultdict(int)
        t.forget()
        for b in batches:
            for c in slices(b):
                rows = []
                for doc, ids in zip(c.column("doc_id").to_pylist(), t.batch([x or "" for x in c.column("text").to_pylist()]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        k = min(window, n - s)
                        rows.append((doc, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n, part, seen[k]))
                        seen[k] += 1
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)
        t.forget()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long")


def combinations(hist: np.ndarray, window: int, most: int = 6000) -> np.ndarray:
    """Shallow combinations that fill a window, or a power of two, which needs no padding either:
    rows of up to three lengths, 0 for none. Triples are tried around the commonest lengths."""
    have = np.flatnonzero(hist)
    have = have[have > 0]
    fills = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    single = np.array([[f, 0, 0] for f in fills if hist[f]]).reshape(-1, 3)
    pairs = []
    for f in fills[-3:]:
        a = have[(have <= f // 2)]
        a = a[hist[f - a] > 0]
        pairs.append(np.stack([f - a, a, np.zeros_like(a)], 1))
    triples = []
    common = have[np.argsort(-hist[have], kind="stable")][:64]
    for x in common:
        rest = window - x
        a = have[(have <= rest // 2) & (have < window)]
        a = a[hist[rest - a] > 0] if rest > 0 else a[:0]
        triples.append(np.sort(np.stack([np.full_like(a, x), rest - a, a], 1), axis=1)[:, ::-1])
    t = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *triples]), axis=0)
    if len(t) > most:
        t = t[np.argsort(-hist[t].min(axis=1), kind="stable")[:most]]
    return np.concatenate([single.astype(np.int64), *pairs, t.astype(np.int64)])


def solve(combos: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x with sum over combos of x * its lengths nearest to hist: accelerated projected
    gradient. Column norms are at most 3, row sums bound the Lipschitz constant."""
    if not len(combos):
        return np.zeros(0)
    n = len(hist)
    valid = combos > 0
    flat, owner = combos[valid], np.nonzero(valid)[0]
    apply = lambda x: np.bincount(flat, x[owner], n)
    back = lambda r: np.bincount(owner, r[flat], len(combos))
    target = hist.astype(float)
    v = np.random.default_rng(0).random(len(combos))
    for _ in range(20):
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        nx = np.maximum(0, y - back(apply(y) - target) / (1.02 * top))
        m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = nx + (momentum - 1) / m * (nx - x)
        x, momentum = nx, m
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths, repeats) of sequences that use every piece of the histogram once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[int], int]] = []
    if left[window]:
        out.append(([window], int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    x = np.floor(solve(combos, left) + 1e-6).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        if x[k] <= 0:
            break
        c = [int(v) for v in combos[k] if v]
        times = min(int(x[k]), *(int(left[v]) // c.count(v) for v in c))
        if times > 0:
            out.append((c, times))
            for v in c:
                left[v] -= times
    for first in range(window, 0, -1):  # greedy: each step uses up a length at least
        while left[first] > 0:
            c, room, free = [first], window - first, left.copy()
            free[first] -= 1
            while room > 0:
                fit = np.flatnonzero(free[1 : room + 1])
                if not len(fit):
                    break
                v = int(fit[-1]) + 1
                k = min(int(free[v]), room // v)
                c += [v] * k
                free[v] -= k
                room -= k * v
            times = min(int(left[v]) // c.count(v) for v in set(c))
            out.append((c, times))
            for v in c:
                left[v] -= times
    return out


def places(sequences: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as places: those of a length in order of rank, runs of equal offset together."""
    rows, base, taken = [], 0, defaultdict(int)
    for lengths, times in sequences:
        offset = 0
        for v in lengths:
            rows.append((v, taken[v], base, offset))
            taken[v] += times
            offset += v
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places every piece of `tokenize`'s stored table."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length: at most `window`
        hist[r["length"]] = r["n"]
    at = spark.sparkContext.broadcast(places(plan(hist, window)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))

    @released
    def run(batches):
        p = at.value
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            new = [pa.array(p["sequence"][k] + rank - p["first"][k]), pa.array(p["offset"][k])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *new], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    return pack(stored(tokenize(keyed_text(docs), path, window), "pieces"), window)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs, path)
