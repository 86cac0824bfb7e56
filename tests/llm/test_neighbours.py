"""Embedding near-dedup against brute force."""

import numpy as np
import pytest
from millrace.llm import neighbours
from millrace.llm.base import with_row

from .conftest import hard_vectors


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows."""
    groups, out = {}, []
    for k, (_, v) in enumerate(rows):
        if usable(v):
            groups.setdefault(len(v), []).append(k)
    links, root = [0] * len(rows), list(range(len(rows)))
    for at in groups.values():
        x = neighbours.unit(np.array([np.float32(rows[k][1]) for k in at], np.float64))
        linked = x @ x.T >= cosine
        for i, a in enumerate(at):
            links[a] = int(linked[i].sum()) - 1
        seen = set()
        for i in range(len(at)):
            front, part = [i], []
            while front:
                j = front.pop()
                if j not in seen:
                    seen.add(j)
                    part.append(j)
                    front += np.flatnonzero(linked[j]).tolist()
            for j in part:
                root[at[j]] = [rows[at[k]][0] for k in part]
    for k, (d, _) in enumerate(rows):
        ids = [x for x in root[k] if x is not None] if isinstance(root[k], list) else [d]
        least = min(ids) if ids else None
        out.append((d, links[k], least, d == least))
    return sorted(out, key=str)


def run(spark, rows):
    df = with_row(spark.createDataFrame([(d, None if v is None else [float(x) for x in v]) for d, v in rows], "vec_id long, vec array<float>").repartition(3))
    return sorted((tuple(r) for r in neighbours.near_duplicates(df).collect()), key=str)


def test_hard_vectors(spark, hard):
    got = sorted((tuple(r) for r in neighbours.op12_neighbours(spark, hard).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute([x[:2] for x in hard_vectors()])


@pytest.mark.parametrize("chunk", [512, 7])
def test_hot_groups_in_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    r = np.random.default_rng(1)
    centre = r.standard_normal((3, 64))
    v = np.concatenate([r.standard_normal((300, 64)), *(c + r.standard_normal((60, 64)) * s for c, s in zip(centre, (0.1, 0.3, 0.45), strict=True))])
    assert run(spark, list(enumerate(v))) == brute(list(enumerate(v)))


@pytest.mark.parametrize("d", [2, 3, 8, 16, 64, 300])
def test_recall_near_the_bound(d):
    """Pairs with cosines of 0.9 to 0.91, the hardest: a shared filter for nearly all."""
    r = np.random.default_rng(d + 99)
    n = 500
    a = neighbours.unit(r.standard_normal((n, d)))
    b = r.standard_normal((n, d))
    b = neighbours.unit(b - (a * b).sum(1, keepdims=True) * a)
    c = r.uniform(0.9, 0.91, (n, 1))
    plan = neighbours.plan(20_000, d, 0.9)
    found, size = np.zeros(n, bool), 0
    for number in range(plan.codes):
        lists = []
        for x in (a, c * a + np.sqrt(1 - c * c) * b):
            at, name = neighbours.decode(x, plan, number)
            lists.append([set(name[at == k].tolist()) for k in range(n)])
            size += len(at) / n / 2
        found |= [bool(x & y) for x, y in zip(*lists, strict=True)]
    print(f"{d} dimensions: recall {found.mean():.4f}, {size:.0f} filters a vector, {plan}")
    assert found.mean() >= 0.98 and size < 3000


def test_list_decoding_finds_every_filter():
    r = np.random.default_rng(2)
    x = neighbours.unit(r.standard_normal((20, 12)))
    rotation, words = neighbours.code(12, 3, 9, 2)
    every = {}
    for i in range(9):
        for j in range(9):
            for k in range(9):
                every[((2 * 9 + i) * 9 + j) * 9 + k] = np.concatenate([words[0][i], words[1][j], words[2][k]])
    want = {(v, f) for v, y in enumerate(x @ rotation) for f, c in every.items() if y @ c >= 0.35}
    at, name = neighbours.decode(x, neighbours.Plan(0.35, 3, 9, 3), 2)
    assert set(zip(at.tolist(), name.tolist(), strict=True)) == want and want


def test_a_tie_at_the_bound_is_decided_by_exact_sums():
    b = np.array([0.9, np.sqrt(1 - 0.81)])
    x = np.array([[1.0, 0.0], b])
    assert neighbours.links(x, 0.9)[0, 1] == (neighbours.exact_cosine(x[0], x[1]) >= 0.9)


@pytest.mark.parametrize("most", [8192, 11])
def test_sketches_lose_no_link(spark, most, monkeypatch):
    """Groups around the bound, in filters that are whole and in tiles of hot ones."""
    monkeypatch.setattr(neighbours, "SKETCHES", most)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    r = np.random.default_rng(6)
    centre = r.standard_normal((5, 24))
    v = np.concatenate([r.standard_normal((200, 24)), *(c + r.standard_normal((30, 24)) * s for c, s in zip(centre, (0.05, 0.2, 0.32, 0.34, 0.4), strict=True))])
    assert run(spark, list(enumerate(v))) == brute(list(enumerate(v)))


def test_sketch_errors_bound_the_cosine():
    r = np.random.default_rng(7)
    x = neighbours.unit(r.standard_normal((200, 40)) * r.exponential(1, (200, 40)) ** 3)
    raw = neighbours.sketch(x)
    q = neighbours.unit(np.array([np.frombuffer(b[:40], np.int8) for b in raw], np.float64))
    e = np.array([np.frombuffer(b[40:], np.float32)[0] for b in raw], np.float64)
    assert (np.abs(q @ q.T - x @ x.T) <= e[:, None] + e[None, :]).all()


@pytest.mark.parametrize("n", [2_000, 50_000, 600_000])
def test_filters_of_a_vector_stay_few(n):
    """What is shuffled follows from the filters of a vector: 180 of them at 50,000 vectors filled the disk."""
    plan = neighbours.plan(n, 64, 0.9)
    at, _ = neighbours.decode(neighbours.unit(np.random.default_rng(n).standard_normal((300, 64))), plan)
    assert plan.codes * len(at) / 300 <= 12
