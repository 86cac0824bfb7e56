"""Importance resampling towards a target distribution, native: hashed n-gram features, bucket gains
of target over source, Gumbel keys.

1. Words are posexploded into a position table (row, pos, word). For orders above 1, lead() over each
   row's positions brings the following words, and every order's run is one feature.
2. Features are hashed into buckets and grouped: at most `buckets` rows on each side, so the gains
   are a table of proven size, which is broadcast.
3. The features meet their gains and are summed by row; partial sums leave one row a document
   in each task before anything is shuffled.
4. Rows are ranked by running totals over a histogram of scores (two levels: scores within blocks,
   blocks), and by row_number only among equal scores, so no task holds all rows.

Defined results: a null or empty text, or one without words, has no features, weight 0 and a score, and
is drawn only if min_words is 0; a document of fewer words than an order has no run of it; a very
long text is one row of the position table for each word; repeated rows are scored and ranked each,
in any order among themselves; a null id counts as an empty one in the key and loses ties; empty
tables give empty results, an empty target gains 0 words; other columns are dropped, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import ROW, documents, fixed, keyed_text, stored, with_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that stand between words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Neighbouring scores whose counts are added in one step of the ranking.
BLOCK = 256


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lowered."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def positions(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, word): the position table of a table with a text."""
    return df.select(key, F.posexplode(words(F.col("text"))).alias("pos", "word"))


def features(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """(key, feature) of every run of least to most words. Order 1 needs no neighbour, so no window."""
    at = positions(df, key)
    if most == 1:
        return at.select(key, F.col("word").alias("feature"))
    following = Window.partitionBy(key).orderBy("pos")
    for k in range(1, most):
        at = at.withColumn(f"next{k}", F.lead("word", k).over(following))
    runs = []
    for n in range(least, most + 1):
        parts = [F.col("word"), *(F.col(f"next{k}") for k in range(1, n))]
        whole = F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:])  # null where a word is missing
        runs.append(whole)
    return at.select(key, F.explode(F.filter(F.array(*runs), lambda f: f.isNotNull())).alias("feature"))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets that a source feature falls into: at most `buckets` rows.
    source, target: tables of (feature)."""
    count = lambda df, name: df.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))
    both = count(source, "s").join(count(target, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    as_double = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (as_double["t"] + 1) * (as_double["all_s"] + buckets) / ((as_double["s"] + 1) * (as_double["all_t"] + buckets))
    return both.where("s > 0").join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """A Gumbel variable, times 1000 and floored, that follows from the seed and a row's key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def floored_mean(total: Column, count: Column) -> Column:
    """floor(total / count) in whole numbers."""
    return F.call_function("div", total - F.pmod(total, count), count)


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """(row, rank) of the best floor(percent * rows / 100) of (row, doc_id, score)."""
    block = F.floor(F.col("score") / BLOCK).cast("long")
    at = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", block)
    blocks = at.groupBy("block").agg(F.sum("n").alias("n"))
    everything = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Blocks are few at any size of the input: scores lie within some tens of thousands.
    starts = at.select("block", "score", inside.alias("inside")).join(blocks.select("block", before.alias("before")), "block")
    starts = starts.join(F.broadcast(everything)).select("score", (F.col("inside") + F.col("before")).alias("start"), F.floor(F.col("rows") * percent / 100).cast("long").alias("draw")).where("start < draw")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), ROW)
    placed = scored.join(starts, "score").withColumn("rank", F.col("start") + F.row_number().over(order))
    return placed.where("rank <= draw").select(ROW, "rank")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """(row id, doc_id, n_features, weight, score, rank) of (row id, doc_id, text) against target texts."""
    docs = fixed(docs)  # read more than once: row ids must stay
    own = features(docs, ROW, least, most)
    gain = gains(own, features(with_row(target.select("text")), ROW, least, most), buckets)
    met = own.select(ROW, bucket(F.col("feature"), buckets).alias("bucket")).join(F.broadcast(gain), "bucket")
    sums = met.groupBy(ROW).agg(F.count(F.lit(1)).alias("n_features"), F.sum("gain").alias("total"))
    rows = docs.select(ROW, "doc_id", F.size(words(F.col("text"))).alias("n_words")).join(sums, ROW, "left")
    weight = F.when(F.col("n_features").isNull(), F.lit(0)).otherwise(floored_mean(F.col("total"), F.col("n_features"))).cast("long")
    scored = stored(rows.select(ROW, "doc_id", "n_words", F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"), weight.alias("weight"), (weight + gumbel(F.col("doc_id"), seed)).alias("score")), "weights")
    drawn = ranked(scored.where(F.col("n_words") >= min_words).select(ROW, "doc_id", "score"), percent)
    return scored.join(drawn, ROW, "left").select(ROW, "doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(keyed_text(documents(spark, sf_dir)), target).select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum goes byte by byte over each distinct word, by a table that `c` builds from its rule.
ORACLE_SQL = r"""
WITH RECURSIVE b AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END, k + 1 FROM b WHERE k < 8),
c AS (SELECT list(v ORDER BY i) AS t FROM b WHERE k = 8),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS f FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS f FROM w),
d AS (SELECT DISTINCT f FROM u UNION SELECT DISTINCT f FROM g),
h AS (SELECT f, hex(encode(f)) AS x FROM d),
k AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST(concat('0x', x[2 * i + 1 : 2 * i + 2]) AS BIGINT))),
  lambda a, y: xor(t[CAST(xor(a & 255, y) AS INTEGER) + 1], a // 256)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM h, c),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (f) GROUP BY 1),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
a AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), z),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(gain) AS BIGINT) / count(*)) AS BIGINT) AS weight FROM u JOIN k USING (f) JOIN a USING (bucket) GROUP BY 1),
p AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST(concat('0x', left(sha256(concat('2024:', doc_id)), 8)) AS BIGINT) AS h FROM w LEFT JOIN m USING (doc_id)),
o AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM p),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM o WHERE words >= 20)
SELECT o.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM o LEFT JOIN r USING (doc_id)"""
