"""Phrase mining against direct counts."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from millrace.llm import phrases

from .conftest import hard_rows


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := [x for x in re.split(r"[\x20\x09]+", p) if x])]


def direct(rows, most=3, least_count=10, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least_count}
    longest = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(longest[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in cand.items():
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if not longest[lang, w] or 100 * longest[lang, w] < 50 * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def zipf(seed, docs, vocabulary=60, size=80):
    r = np.random.default_rng(seed)
    marks = [" ", " ", " ", " ", ". ", ", ", "\n", "\t", "  "]
    out = []
    for k in range(docs):
        w = [f"W{min(int(x), vocabulary)}é" if x % 3 else f"w{min(int(x), vocabulary)}" for x in r.zipf(1.4, int(r.integers(1, size)))]
        out.append((["en", "de", None, "und"][k % 4], "".join(x + str(r.choice(marks)) for x in w)))
    return [*out, ("en", None), ("en", ""), ("fr", " ., \n"), (None, "one")]


@pytest.mark.parametrize(("most", "shard"), [(3, 4 << 20), (3, 2000), (2, 900), (4, 2000)])
def test_against_direct_counts(spark, most, shard, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = zipf(most, 300)
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "lang string, text string, n long, phrase string").repartition(3)
    want = direct(rows, most)
    assert len(want) > 50 and got(phrases.mine(df, most=most)) == want


def test_first_rows_and_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 97)
    rows = [("en", " ".join(t or "" for _, t in zipf(9, 200)))]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(phrases.mine(df, first=7)) == direct(rows, first=7)


def test_hard_rows(spark, hard):
    assert got(phrases.op11_phrases(spark, hard)) == direct([(x[2], x[1]) for x in hard_rows()])


def test_a_crowded_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = zipf(5, 200)
    assert got(phrases.mine(spark.createDataFrame(rows, "lang string, text string"))) == direct(rows)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big - 7, big - 1, big)], "a long, l long, r long").select(phrases.score(phrases.F.col("a"), phrases.F.col("l"), phrases.F.col("r"))).first()
    assert row[0] == 1_000_000 * (big - 7) ** 2 // ((big - 1) * big)


def test_intervals_are_all_ngrams():
    r = random.Random(3)
    for _ in range(50):
        ids = np.array([r.randint(1, 4) for _ in range(r.randint(1, 60))])
        last = np.array([r.random() < 0.2 for _ in ids[:-1]] + [True])
        cuts = [0, *(np.flatnonzero(last) + 1)]
        for n in (1, 2, 3, 5):
            want = Counter(tuple(ids[i : i + n]) for a, b in pairwise(cuts) for i in range(a, b - n + 1))
            at, count = phrases.intervals(ids, last, len(ids), n)
            assert {tuple(ids[i : i + n]): c for i, c in zip(at, count, strict=True)} == want
