"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are square roots of the shares of its hashed byte triples, and of its words that
repeat. One weight vector is shared by all grades; ordered thresholds t turn the score s into
P(grade > j) = 1 / (1 + exp(t[j] - s)). Their sum is the expected grade, one of them the tail
probability by which texts are selected.

It is fitted on the driver, on at most SAMPLE labelled rows (those of the smallest hashes of their
ids); each executor scores whole texts.

Defined results: a null text is empty; an empty text has no features and gets the grades of score
0; a very long text counts whole, its words hashed in blocks; no labels give every row tail 1 (all are kept); repeated rows are scored each; of several
labels of one id the least grade counts, of several texts of one id the one whose features come
first as bytes; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import hashing as H
from .base import documents, keyed_text, released, ship

BINS = 2048
#: Most labelled rows that the fit looks at, at any size of the input.
SAMPLE = 4000
GRADES = 3
#: The tail probability looked at is P(grade >= TAIL); texts at or above KEEP are kept.
TAIL, KEEP = 1, 0.5
STEPS = 400


def _few(data: np.ndarray, off: np.ndarray, most: int = 256):
    """Runs of texts with their words, of at most so many texts: each has a row of BINS numbers."""
    for i, j, h, at in H.words(data, off):
        for k in range(i, j, most):
            e = min(j, k + most)
            yield k, e, h[at[k - i] : at[e - i]], at[k - i : e - i + 1] - at[k - i]


def features(data: np.ndarray, off: np.ndarray, bins: int = BINS):
    """Yields (first text, last text + 1, float32 features) for runs of texts."""
    last = bins - 16  # the last bins hold how much of the text repeats
    mult = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
    for i, j, h, at in _few(data, off):
        b, cut = data[off[i] : off[j]].astype(np.uint32), off[i : j + 1] - off[i]
        x = np.zeros((j - i, bins), np.float32)
        if len(b) >= 3:
            k = (b[:-2] * mult[0]) ^ (b[1:-1] * mult[1]) ^ (b[2:] * mult[2])
            k ^= k >> np.uint32(15)
            k *= np.uint32(0x2C1B3C6D)
            k ^= k >> np.uint32(13)
            k %= np.uint32(last)
            for d in range(j - i):
                own = k[cut[d] : max(cut[d], cut[d + 1] - 2)]
                if len(own):
                    x[d, :last] = np.bincount(own, minlength=last)
                    x[d, :last] /= len(own)
        run, owner = H.shingles(h, at, 3)
        total = np.bincount(owner, minlength=j - i)
        pair = np.unique(H.mix(run * np.uint64(3) + owner.astype(np.uint64)), return_index=True)[1]
        fresh = np.bincount(owner[pair], minlength=j - i)
        repeat = np.where(total > 0, 1 - fresh / np.maximum(total, 1), 0)
        x[np.arange(j - i), last + np.minimum(15, (repeat * 16).astype(int))] = np.where(total > 0, 0.25, 0)
        yield i, j, np.sqrt(x)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        z = np.clip(x @ self.weights, -60, 60)[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, ridge: float = 1e-4, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood by Adam; gaps between thresholds are exponentials, so they stay ordered."""
    n, d = x.shape
    if n == 0:
        return Ordinal(np.zeros(d, np.float32), np.full(grades - 1, -60.0))
    share = np.clip([(grade > j).mean() for j in range(grades - 1)], 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    t = np.maximum.accumulate(first + 1e-2 * np.arange(grades - 1))
    p = np.concatenate([np.zeros(d), [t[0]], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:d], np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))
        z = x @ w.astype(np.float32)
        # P(grade <= j), with sure bounds on both sides
        c = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(z[:, None] - t[None, :], -60, 60))), np.ones((n, 1))], axis=1)
        row = np.arange(n)
        hi, lo = c[row, grade + 1], c[row, grade]
        q = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / q, lo * (1 - lo) / q
        gz = (dhi - dlo) / n  # of minus the log-likelihood, by z
        gt = np.array([-(dhi[grade == j].sum() - dlo[grade == j + 1].sum()) / n for j in range(grades - 1)])
        later = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([x.T @ gz.astype(np.float32) + ridge * w, later[:1], later[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(p[:d].astype(np.float32), np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])])))


def grade_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for poor text, 1 for good but toxic text, 2 for good clean text."""
    g = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", g.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits on (doc_id, grade) rows joined to (doc_id, text): at most `sample` of them."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers

    @released
    def run(batches):
        for b in batches:
            data, off = H.buffers(b.column("text"))
            x = [f.tobytes() for _, _, part in features(data, off) for f in part]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(x, pa.binary())], ["doc_id", "grade", "x"])

    got = rows.mapInArrow(run, "doc_id long, grade int, x binary").toPandas().sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), BINS)
    return fit(x, got["grade"].to_numpy(np.int64))


def score(df: DataFrame, model: Ordinal, tail: int = TAIL) -> DataFrame:
    """Adds expected_grade and tail_probability to df (with a text column, nulls empty)."""
    at = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    @released
    def run(batches):
        m = at.value
        for b in batches:
            t = b.column("text")
            data, off = H.buffers(t.fill_null(""))
            p = np.concatenate([np.zeros((0, len(m.thresholds))), *(m.above(x) for _, _, x in features(data, off))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(axis=1)), pa.array(p[:, tail - 1])], [*names, "expected_grade", "tail_probability"])

    schema = StructType([*df.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType())])
    return df.mapInArrow(run, schema)


def select(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """The rows of docs whose tail probability reaches keep; docs' columns as they were."""
    d = docs.select(F.struct(*docs.columns).alias("__doc"), F.coalesce("text", F.lit("")).alias("text"))
    return score(d, model).where(F.col("tail_probability") >= keep).select("__doc.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected."""
    d = keyed_text(documents(spark, sf_dir)).select("doc_id", "text")
    model = train(d, grade_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(d, model).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("selected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier selects."""
    ship(spark)
    grades = grade_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return select(docs, train(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), grades))
