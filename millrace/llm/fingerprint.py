"""Document fingerprints with DataFrame functions only: bottom-k sketches of shingle hashes.

A sketch is the ascending array of the K smallest distinct hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole (`merge`, `merge_all`). Two sketches estimate
resemblance, containment and distinct shingle counts.

Words are lower-cased runs between bytes 9-13 and 32. A text of fewer than five words (but some)
has one shingle, of all its words; a text without words, and a null one, has an empty sketch.
Two empty sketches resemble each other fully, an empty and another one not at all. Equal texts
have equal sketches. A very long text is sketched whole, and only hashes of the lowest part of the
range are sorted. Repeated rows are kept; only the named columns are, so none can clash; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, keyed_text

K = 128
SHINGLE = 5
#: Ids per bucket on average when each document's neighbour is looked up.
BUCKET = 64


def hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hash of every n-word shingle of text, in order."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(
        F.array(h),
        lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.xxhash64(*(F.element_at(a, (i + d).cast("int")) for d in range(n)))))
        .when(F.size(a) > 0, F.array(F.xxhash64(a)))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """Bottom-k sketch. Of long texts only hashes in the lowest part of the range, wide enough to hold
    8 k of them on average, are sorted; should it hold fewer than k distinct ones, all are."""

    def bottom(h: Column) -> Column:
        share = F.lit(8.0 * k) / F.size(h)
        limit = (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("bigint")
        few = F.when(F.size(h) > 16 * k, F.sort_array(F.array_distinct(F.filter(h, lambda x: x < limit))))
        return F.transform(F.array(few), lambda a: F.slice(F.when(F.size(F.coalesce(a, F.array().cast("array<bigint>"))) >= k, a).otherwise(F.sort_array(F.array_distinct(h))), 1, k))[0]

    return F.transform(F.array(hashes(text, n)), bottom)[0]


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """(key, column): the sketch of each key's parts. Ranks the distinct hashes; those beyond the k
    smallest of a task's share of a key are dropped before the shuffle."""
    item = df.select(key, F.explode(column).alias("h")).distinct()
    w = Window.partitionBy(key).orderBy("h")
    return item.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that both have."""
    u = merge(a, b, k)
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def written(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (with doc_id) and, as next_<column>, those of the next row by descending doc_id (nulls
    last, ties by text); the last row's next is the first.

    Ids are dealt into buckets of about BUCKET ids, so no task holds the whole order. The last row
    of a bucket takes the first of the next bucket that has rows; that table of buckets is ordered
    the same way, over buckets of buckets."""
    lo, hi, n = df.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    lo, hi = lo or 0, hi or 0
    width = max(1, -(-(hi - lo + 1) * BUCKET // max(n, 1)))
    d = df.withColumn("__bucket", F.coalesce(F.floor((F.col("doc_id") - lo) / width), F.lit(-1)).cast("long"))
    row = F.struct(*columns)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    w = Window.partitionBy("__bucket").orderBy(*order)
    d = d.withColumns({"__next": F.lead(row).over(w), "__place": F.row_number().over(w)})
    heads = d.where("__place = 1").select("__bucket", row.alias("__head"))
    # The same for buckets, of which only numbers are moved: the bucket before each, over 4096 at a time.
    b = heads.select("__bucket", F.floor(F.col("__bucket") / 4096).alias("__super"))
    wb = Window.partitionBy("__super").orderBy(F.desc("__bucket"))
    b = b.withColumn("__to", F.lead("__bucket").over(wb))
    tops = b.groupBy("__super").agg(F.max("__bucket").alias("__top"))
    ws = Window.orderBy(F.desc("__super"))  # a row per 4096 buckets, about 260,000 documents
    tops = tops.withColumns({"__down": F.coalesce(F.lead("__top").over(ws), F.first("__top").over(ws))}).select("__super", "__down")
    b = b.join(tops, "__super").select("__bucket", F.coalesce("__to", "__down").alias("__to"))
    first = b.join(heads.select(F.col("__bucket").alias("__to"), "__head"), "__to").select("__bucket", "__head")
    d = d.join(first, "__bucket", "left").withColumn("__next", F.coalesce("__next", "__head"))
    return d.select(*df.columns, *(F.col(f"__next.{c}").alias(f"next_{c}") for c in columns))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keyed_text(documents(spark, sf_dir)).select("doc_id", "text")
    d = with_next(d.withColumn("sketch", sketch(F.col("text"))), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
