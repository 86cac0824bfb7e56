"""Importance resampling against a direct version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from millrace.llm import resampling
from millrace.llm.base import keyed_text

from .conftest import hard_rows, passage_of


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def direct(docs, target, least=1, most=1, buckets=10_000, seed=2024, percent=10, min_words=20):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    own = [features(t) for _, t in docs]
    s, t = Counter(x for f in own for x in f), Counter(x for text in target for x in features(text))
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    rows = []
    for (d, text), f in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_hard_rows(spark, hard):
    docs = [x[:2] for x in hard_rows()]
    assert got(resampling.op13_resampling(spark, hard)) == direct(docs, ["one two three", None, "", passage_of(hard_rows())])


@pytest.mark.parametrize(("least", "most"), [(1, 2), (2, 3), (1, 4)])
def test_runs_of_words(spark, least, most):
    docs = [(k, t) for k, t in enumerate(["a b", "a", "", None, *(f"x{k % 7} y{k % 5} Z{k % 3}, a b c d{k} " * (k % 9) for k in range(120))])]
    target = ["a b c", "x1 y2 z", None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = resampling.resample(keyed_text(frame), spark.createDataFrame([(t,) for t in target], "text string"), least, most, 500, 7, 35, 3)
    assert got(found) == direct(docs, target, least, most, 500, 7, 35, 3)


def test_ranks_pass_over_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 3)
    rows = [(k, k if k % 50 else None, (k * 7919) % 40 - 20) for k in range(400)]
    found = resampling.ranked(spark.createDataFrame(rows, f"{resampling.ROW} long, doc_id long, score long"), 73)
    want = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))[:292]
    assert sorted(tuple(r) for r in found.collect()) == sorted((r[0], place) for place, r in enumerate(want, 1))


def test_an_empty_target(spark):
    docs = [(k, "alpha beta gamma " * k) for k in range(12)]
    found = resampling.resample(keyed_text(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame([], "text string"))
    assert got(found) == direct(docs, [])
