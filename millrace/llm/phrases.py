"""Phrase collocation mining: suffix arrays over word ids, one per shard, whose common-prefix intervals
give the counts of all n-grams; counts are merged by (lang, phrase).

1. A task gathers texts up to SHARD bytes and numbers their (lang, word) pairs exactly. No phrase crosses
   a piece, a document or a language: a separator stands after each piece.
2. Prefix doubling (rank of a run of 2k words = rank of the pair of its halves' ranks) sorts the
   suffixes as deep as the phrase. The ranks of all depths give the common prefixes of neighbours in
   the suffix array; each maximal interval whose prefixes share n words is one n-gram, its length the count.
3. Counts are merged by (lang, phrase), level by level: words, then pairs of frequent words, then triples of
   frequent pairs, as all parts of a phrase are as frequent as it is at least. What is frequent one level below
   is known to the shards from a bit filter of FILTER_BITS bits, which never misses a frequent phrase: it only
   leaves out others, so counts are exact at any size, and its size is the same for any input.
4. Candidates meet the counts of their parts by joins on (lang, part); longer candidates give each
   contained phrase the largest count of its containers; scores are exact decimals.
5. The first rows of a language are ranked within SALTS parts of it, then among the parts' first rows.

Defined results: a null or empty text, or one without words, adds nothing; a null lang is `und`; a very long
text is cut into shards whose last words are looked at but not counted twice; repeated rows count each;
phrases of equal score and count rank by their bytes; null ids matter nowhere; an empty table gives an empty
table; other columns are dropped, so none can clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing as H
from .base import FILTER_BITS, documents, filter_of, groups_for, released, stored, text_bytes

#: Bytes of text that one suffix array spans, and words at most of a longer text.
SHARD, SHARD_WORDS = 4 << 20, 1_000_000
#: Bytes of text for each partition that counts are merged in.
MERGE_BYTES = 4 << 20
#: Parts of a language that are ranked apart first.
SALTS = 64
UNKNOWN = "und"

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = BREAK[10:14] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of texts, the text of each, and which words end a piece."""
    start, end = H.word_spans(data, off, GAP)
    text = np.searchsorted(off, start, side="right") - 1
    words = H.spelled(data, start, end, pa.string())
    breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
    last = np.ones(len(start), bool)
    if len(start):
        last[:-1] = (breaks[start[1:]] > breaks[end[:-1]]) | (text[1:] != text[:-1])
    return words, text, last


def doubled(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Ranks of the runs of 1, 2, 4 .. words that start at each place, until a run spans `most` words;
    ids are 1 and up, separators and the end 0. The last ranks give the order of the suffixes."""
    ranks, k = [ids], 1
    while k < most:
        r = ranks[-1]
        after = np.zeros(len(r), np.int64)
        after[: len(r) - k] = r[k:]
        _, pair = np.unique(r * (int(r.max(initial=0)) + 1) + after, return_inverse=True)
        ranks.append(pair.astype(np.int64) + 1)
        k *= 2
    return ranks


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Words, `most` at the most, that the suffixes at a and b share from their first on."""
    size = len(ranks[0])
    got = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < size) & (y < size) & (got < most)
        i = np.flatnonzero(inside)
        same = i[ranks[level][x[i]] == ranks[level][y[i]]]
        got[same] += 1 << level
    return np.minimum(got, most)


def intervals(ids: np.ndarray, last: np.ndarray, own: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of one occurrence, count) of all n-grams of a sequence of word ids (1 and up) that ends a piece
    after each `last`; occurrences from place `own` on aren't counted."""
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A separator after each piece: place of each word among words and separators.
    place = np.arange(len(ids)) + np.concatenate([[0], np.cumsum(last[:-1])])
    line = np.zeros(int(place[-1]) + 2, np.int64)
    line[place] = ids
    ends = np.flatnonzero(line == 0)
    left = np.minimum(ends[np.searchsorted(ends, place)] - place, n)  # words up to the piece's end
    ranks = doubled(line, n)
    order = np.argsort(ranks[-1][place[:own]], kind="stable")
    at = place[:own][order]
    left = left[:own][order]
    share = np.zeros(len(at), np.int64)
    share[1:] = np.minimum(common(ranks, at[:-1], at[1:], n), np.minimum(left[:-1], left[1:]))
    start = np.flatnonzero(share < n)
    count = np.diff(start, append=len(at))
    whole = left[start] == n
    return order[start[whole]], count[whole]


def hash_strings(a: pa.Array) -> np.ndarray:
    data, off = H.buffers(a)
    return H.span_hash(H.prefix(data), off[:-1], off[1:])


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words (given by their hashes) that start at each place but the last n - 1."""
    size = max(0, len(h) - n + 1)
    out = h[:size].copy()
    for k in range(1, n):
        out = H.mix(out * np.uint64(H.BASE) + h[k : k + size])
    return out


def _bits(size: int):
    """(cell, mask) of the filter of (lang, phrase) rows."""

    @released
    def run(batches):
        for b in batches:
            word = pc.split_pattern(b.column("phrase"), " ")
            n = len(word[0]) if len(b) else 0  # all phrases of a level have as many words
            h = hash_strings(word.flatten()) if n else np.zeros(0, np.uint64)
            lang = np.repeat(hash_strings(b.column("lang")), n)
            yield H.cells(run_hash_rows(H.mix(h ^ lang).reshape(len(b), n)) if n else h, size)

    return run


def run_hash_rows(h: np.ndarray) -> np.ndarray:
    out = h[:, 0].copy()
    for k in range(1, h.shape[1]):
        out = H.mix(out * np.uint64(H.BASE) + h[:, k])
    return out


def bit_filter(frequent: DataFrame) -> np.ndarray:
    """The filter of (lang, phrase): at most FILTER_BITS / 64 rows come to the driver, whatever the input."""
    return filter_of(frequent.select("lang", "phrase").mapInArrow(_bits(FILTER_BITS), "cell int, mask long"), FILTER_BITS)


def possible(h: np.ndarray, last: np.ndarray, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to keep of words (by hash), and which of them end a piece then, so that every run of n words within a
    piece whose parts of n - 1 words both pass the filter stays whole."""
    size = len(h)
    inside = np.zeros(size + 1, bool)  # a run of n - 1 words starts here, within a piece, and passes
    run = run_hash(h, n - 1)
    inside[: len(run)] = H.passes(bits, run)
    for k in range(n - 2):
        inside[: len(run)] &= ~last[k : k + len(run)]
    start = np.flatnonzero(inside[:-1] & inside[1:] & ~last)  # and one starts after it
    if n > 2:
        start = start[~last[start]]
    keep, tied = np.zeros(size + n, bool), np.zeros(size + n, bool)
    for k in range(n):
        keep[start + k] = True
        if k < n - 1:
            tied[start + k] = True
    at = np.flatnonzero(keep[:size])
    return at, ~tied[at]


def _count(n: int, bits: np.ndarray | None):
    """Rows (lang, phrase, n) of n-grams of shards; at n = 1 also (lang, '', n): all words of a language."""

    @released
    def run(batches):
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            lang = t.column("lang").combine_chunks().dictionary_encode()
            data, off = H.buffers(t.column("text"))
            words, text, last = tokens(data, off)
            if not len(words):
                return
            codes = lang.indices.to_numpy()[text].astype(np.int64)
            word = words.dictionary_encode()
            index = word.indices.to_numpy()
            del words, text, data
            if n == 1:
                total = np.bincount(codes, minlength=len(lang.dictionary))
                yield pa.RecordBatch.from_arrays([lang.dictionary.cast(pa.string()), pa.array([""] * len(total)), pa.array(total)], names=["lang", "phrase", "n"])
            else:
                h = H.mix(hash_strings(word.dictionary)[index] ^ hash_strings(lang.dictionary)[codes])
                at, last = possible(h, last, n, bits)
                codes, index = codes[at], index[at]
            pair = codes * len(word.dictionary) + index + 1
            for lo in range(0, len(pair), SHARD_WORDS):
                hi = min(len(pair), lo + SHARD_WORDS)
                to = min(len(pair), hi + n - 1)  # looked at for runs that start before hi
                at, count = intervals(pair[lo:to], last[lo:to], hi - lo, n)
                for part in range(0, len(at), 100_000):
                    i = at[part : part + 100_000] + lo
                    phrase = word.dictionary.take(pa.array(index[i]))
                    for k in range(1, n):
                        phrase = pc.binary_join_element_wise(phrase, word.dictionary.take(pa.array(index[i + k])), " ")
                    yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(codes[i])).cast(pa.string()), phrase, pa.array(count[part : part + 100_000])], names=["lang", "phrase", "n"])

        for b in batches:
            for part in H.parts_of_batch(b, "text", SHARD):
                if held and size + part.nbytes > SHARD:
                    yield from flush()
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield from flush()

    return run


def counts(docs: DataFrame, most: int, least_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of phrases of 1 to most words and least_count occurrences, and (lang, n)."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text")).where("text is not null and text <> ''")
    parts = groups_for(text_bytes(rows), MERGE_BYTES)
    levels, bits, total = [], None, None
    for n in range(1, most + 1):
        found = rows.mapInArrow(_count(n, bits), "lang string, phrase string, n long").repartition(parts, "lang", "phrase")
        merged = stored(found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("phrase") == "") | (F.col("f") >= least_count)), "phrases")
        if n == 1:
            total = merged.where("phrase = ''").select("lang", F.col("f").alias("n"))
            merged = merged.where("phrase <> ''")
        levels.append(merged.select("lang", "phrase", F.lit(n).alias("size"), "f"))
        if n < most:
            bits = bit_filter(merged)
    return reduce(DataFrame.unionByName, levels), total


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10**16."""
    whole = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right))


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine(docs: DataFrame, least: int = 2, most: int = 3, least_count: int = 10, percent: int = 50, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    table, total = counts(docs, most, least_count)
    word = F.split("phrase", " ", -1)
    candidate = table.where(F.col("size") >= least).select("lang", "phrase", "size", F.col("f").alias("a"))
    parts = table.where(F.col("size") < most)
    cuts = candidate.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(word, F.lit(1), F.col("k")).alias("head"), _part(word, F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    side = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    met = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    cut = F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(cut).alias("cut"))
    # Contained phrases of each longer candidate, by length and place.
    inner = F.explode(F.sequence(F.lit(least), F.col("size") - 1)).alias("length")
    longer = candidate.where(F.col("size") > least).select("lang", "phrase", "size", "a", inner)
    longer = longer.select("lang", "phrase", "a", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"))
    held = longer.select("lang", _part(word, F.col("start"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.expr(f"longest IS NULL OR 100 * longest < {percent} * a"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    placed = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return placed.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir).select("lang", "text"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, phrase, k, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k),
s AS (SELECT x.lang, x.phrase, x.k, x.a, x.j, h.f AS l, t.f AS r, CAST(CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longest FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""
