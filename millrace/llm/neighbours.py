"""Embedding near-dedup by spherical-cap filters: structured random product codes, list-decoded, joined on filters, verified.

1. Equal vectors are one entity with a number of copies, so copies never meet as pairs.
2. A filter is a direction: one codeword of each of `blocks` blocks of the (randomly rotated) dimensions.
   A vector passes a filter whose inner product with it reaches `alpha`. All of them are found by list
   decoding, block by block, without visiting the others; the `keep` nearest ones are used.
3. The number of filters follows from the number of vectors, so that a filter has about MEMBERS members at any size;
   alpha and `keep` follow from the dimension and the cosine (`plan`): random pairs at the cosine itself share a kept
   filter in all but 2 cases of 1000. Pairs above the cosine share more.
4. Entities meet in their filters as sketches, a byte a component with the sketch's own error, an entity once in each
   group of filters. An entity stays in a filter if a pair of it may reach the cosine within the errors, and if that
   filter is the first that both have kept: no link is lost, and unrelated members go before vectors move.
   Filters of more than SKETCHES members are spread over tasks in tiles of chunks.
5. What stays is joined with its vectors. Members of a filter are dealt into chunks of CHUNK; each two chunks are
   a tile, so a hot filter is spread over tasks and none is cut short.
6. In a tile all cosines are one product of matrices. A pair counts in the first filter that both stayed in
   and nowhere else, so links are exact without a list of pairs; a spanning forest of a tile's links
   goes to the components.

Defined results: a vector that is null, empty or zero, or holds nulls, NaN or infinities, links with nothing and is
its own component; vectors of different lengths never link; a cosine within 1e-9 of the bound is computed again
with exactly rounded sums; repeated rows are vectors of their own, linked as copies; a component's id is
its least vec_id (nulls aside); other columns, labels too, are dropped; an empty table gives an empty table.
A link may be missed, at the bound about twice in a thousand cases; tests measure it against brute force.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .base import ROW, dropped, groups_for, released, released_group, row_filter, ship, stored, with_row
from .components import components

#: Members of a filter on average; filters at least; filters that a vector passes, of which the nearest are kept.
MEMBERS, LEAST_FILTERS, PASSED = 2048, 64, 60
#: Codewords of a block at most, dimensions of a block at least.
WORDS, LEAST_DIMS = 8192, 8
#: Random pairs at the bound that filters are kept for, until MISSED of them at most share no filter.
PAIRS, MISSED = 1000, 2
#: Members of a chunk, vectors decoded at once, bytes of a group of tiles.
CHUNK, DECODE, GROUP_BYTES = 512, 256, 16 << 20
#: Members of a chunk of sketches, sketches compared at once with a chunk, pairs whose filters are compared at once.
SKETCHES, BLOCK, SLICE = 8192, 512, 1 << 18


class Plan(NamedTuple):
    """Filters are named code * words ** blocks + codewords' numbers."""

    alpha: float
    blocks: int
    words: int
    codes: int
    keep: int = 0  # the nearest filters of a vector that count; 0: all that reach alpha


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cap(d: int, share: float) -> float:
    """The inner product with a fixed direction that a share of all unit vectors reaches."""
    if d == 1:
        return 0.0
    angle = np.linspace(0, np.pi / 2, 200_001)
    mass = np.cumsum(np.sin(angle) ** (d - 2))
    return float(np.cos(np.interp(share, mass / mass[-1] / 2, angle)))


def pairs_at(d: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """PAIRS random pairs of unit vectors with that cosine."""
    r = np.random.default_rng(d)
    a, b = unit(r.standard_normal((PAIRS, d))), r.standard_normal((PAIRS, d))
    b = b - (a * b).sum(axis=1, keepdims=True) * a
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * (unit(b) if d > 1 else 0)


@lru_cache(maxsize=64)
def plan(n: int, d: int, cosine: float) -> Plan:
    """Filters for n vectors of d dimensions: as many as leave about MEMBERS members each, and as many kept by a
    vector as pairs at the bound need. Where too few pass, caps widen."""
    filters = max(LEAST_FILTERS, math.ceil(8 * n / MEMBERS))
    blocks = max(1, min(d // LEAST_DIMS, math.ceil(math.log(filters) / math.log(WORDS))))
    words = math.ceil(filters ** (1 / blocks))
    alpha, (a, b) = cap(d, min(0.5, PASSED / words**blocks)), pairs_at(d, cosine)
    while True:
        one = Plan(alpha, blocks, words, 1)
        worse = np.sort([_shared(x, y) for x, y in zip(_nearest(a, one), _nearest(b, one), strict=True)])
        keep = worse[PAIRS - MISSED - 1]
        if keep < words**blocks or alpha < -1:
            return Plan(alpha, blocks, words, 1, int(min(keep, words**blocks - 1)) + 1)
        alpha -= 0.02


def _nearest(x: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """The filters of each unit vector, nearest first."""
    out = []
    for lo in range(0, len(x), DECODE):
        at, name, gain = _decoded(x[lo : lo + DECODE], plan, 0)
        name = name[np.lexsort((name, -gain, at))]
        out += np.split(name, np.cumsum(np.bincount(at, minlength=len(x[lo : lo + DECODE])))[:-1])
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The least place up to which two lists share a filter; very large if they share none."""
    _, i, j = np.intersect1d(a, b, return_indices=True)
    return int(np.maximum(i, j).min()) if len(i) else 1 << 40


@lru_cache(maxsize=32)
def code(d: int, blocks: int, size: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and the codewords of each block of dimensions; all follow from the numbers alone."""
    r = np.random.default_rng([d, blocks, size, number])
    rotation = np.linalg.qr(r.standard_normal((d, d)))[0]
    words = []
    for part in np.array_split(np.arange(d), blocks):
        c = r.standard_normal((size, len(part)))
        words.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(blocks))
    return rotation, words


def decode(x: np.ndarray, plan: Plan, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of every filter of a code with an inner product of alpha or more with a unit vector, or of
    the nearest of them."""
    at, name, gain = _decoded(x, plan, number)
    if plan.keep:
        order = np.lexsort((name, -gain, at))
        at, name = at[order], name[order]
        near = np.arange(len(at)) - np.searchsorted(at, at) < plan.keep
        at, name = at[near], name[near]
    return at, name


def _decoded(x: np.ndarray, plan: Plan, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, filter, inner product) of every filter of a code that reaches alpha."""
    rotation, words = code(x.shape[1], plan.blocks, plan.words, number)
    parts = np.array_split(x @ rotation, np.cumsum([w.shape[1] for w in words])[:-1], axis=1)
    gain = [p @ w.T for p, w in zip(parts, words, strict=True)]
    best = np.stack([g.max(axis=1) for g in gain], axis=1)
    rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]  # what block k and those after it can add
    at, total, name = np.arange(len(x)), np.zeros(len(x)), np.full(len(x), number, np.int64)
    for k, g in enumerate(gain):
        # Codewords that can still lead to alpha, by vector and falling gain. Keys ascend: gains lie within 1.
        who, word = np.nonzero(g >= (plan.alpha - best.sum(axis=1) + best[:, k])[:, None] - 1e-9)
        key = 4.0 * who - g[who, word]
        order = np.argsort(key)
        who, word, key = who[order], word[order], key[order]
        after = rest[at, k + 1] if k + 1 < plan.blocks else 0.0
        first = np.searchsorted(who, at)
        n = np.maximum(0, np.searchsorted(key, 4.0 * at - (plan.alpha - total - after), side="right") - first)
        step = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, total, name = np.repeat(at, n), np.repeat(total, n), np.repeat(name, n)
        total = total + 4.0 * at - key[step]
        name = name * plan.words + word[step]
    return at, name, total


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, of one length and without nulls, in doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sketch(x: np.ndarray) -> list[bytes]:
    """Unit vectors in a byte a component, each followed by its error: the distance from what its bytes point at."""
    q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    error = np.linalg.norm(x - unit(q.astype(np.float64)), axis=1).astype(np.float32) + np.float32(1e-6)
    return [a.tobytes() + e.tobytes() for a, e in zip(q, error, strict=True)]


def _decode(plans: dict[int, Plan]):
    @released
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for lo in range(0, len(rows), DECODE):
                    part = b.take(pa.array(rows[lo : lo + DECODE]))
                    x = unit(matrix(part.column("vec")))
                    at, name = decode(x, plans[int(d)])
                    order = np.lexsort((name, at))
                    cut = np.searchsorted(at[order], np.arange(len(x) + 1))
                    filters = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(name[order].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("dim"), part.column("entity"), filters, pa.array(sketch(x), pa.binary())], names=["dim", "entity", "filters", "sketch"])

    return run


def _first(lists: np.ndarray, i: np.ndarray, j: np.ndarray, name: int) -> np.ndarray:
    """Whether a filter is the lowest that the lists of rows i and j share; lists are padded with -1."""
    a, b = lists[i], lists[j]
    early = np.zeros(len(i), bool)
    for c in range(a.shape[1]):
        early |= (a[:, c] >= 0) & (a[:, c] < name) & (b == a[:, c, None]).any(axis=1)
    return ~early


def _may_link(q: np.ndarray, error: np.ndarray, lists: np.ndarray, name: int, cosine: float, side: np.ndarray | None) -> np.ndarray:
    """Which members of a filter have a pair there that may reach the cosine; side: only pairs across the two sides count."""
    stays = np.zeros(len(q), bool)
    for lo in range(0, len(q), BLOCK):
        near = q[lo : lo + BLOCK] @ q[lo:].T >= (cosine - error[lo : lo + BLOCK])[:, None] - error[lo:][None, :]
        near &= np.arange(len(q) - lo)[None, :] > np.arange(len(near))[:, None]
        if side is not None:
            near &= side[lo : lo + BLOCK][:, None] != side[lo:][None, :]
        i, j = np.nonzero(near)
        for k in range(0, len(i), SLICE):
            a, b = i[k : k + SLICE] + lo, j[k : k + SLICE] + lo
            some = ~(stays[a] & stays[b])
            a, b = a[some], b[some]
            first = _first(lists, a, b, name)
            stays[a[first]] = stays[b[first]] = True
    return stays


def group_of(filters: np.ndarray, groups: int) -> np.ndarray:
    return (H.mix(filters.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _deal(groups: int, hot: dict[tuple[int, int], int]):
    """Sends each sketch once to each group of its filters, and to the tiles of hot ones (group -1 - filter, tile
    left * 2**15 + right)."""

    @released
    def run(batches):
        for b in batches:
            column, dims = b.column("filters"), b.column("dim").to_numpy()
            count, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(b)), count)
            chunks = np.array([hot.get((d, f), 0) for d, f in zip(dims[owner].tolist(), flat.tolist(), strict=True)] if hot else np.zeros(len(flat)), np.int64)
            cold = chunks == 0
            once = np.unique(owner[cold] * groups + group_of(flat[cold], groups))
            at, group = once // groups, once % groups
            tile, chunk = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            if not cold.all():
                o, f, n = owner[~cold], flat[~cold], chunks[~cold]
                own = (H.mix(b.column("entity").to_numpy().view(np.uint64)[o]) % n.astype(np.uint64)).astype(np.int64)
                o, f, own, n = (np.repeat(x, n) for x in (o, f, own, n))
                other = np.arange(len(o)) - np.searchsorted(o * (1 << 31) + f, o * (1 << 31) + f)
                at, group, chunk = np.concatenate([at, o]), np.concatenate([group, -1 - f]), np.concatenate([chunk, own])
                tile = np.concatenate([tile, np.minimum(own, other) << 15 | np.maximum(own, other)])
            rows = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(tile.astype(np.int32)), pa.array(chunk.astype(np.int32)), *(rows.column(c) for c in ("dim", "entity", "filters", "sketch"))], names=["group", "tile", "chunk", "dim", "entity", "filters", "sketch"])

    return run


def _sift(cosine: float, groups: int, hot: dict[tuple[int, int], int]):
    """(dim, entity, filter) of the members that stay, of a group of filters, or of a tile of a hot one."""

    @released_group
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        entity, chunk = t.column("entity").to_numpy(), t.column("chunk").to_numpy()
        d, group, tile = (t.column(c)[0].as_py() for c in ("dim", "group", "tile"))
        raw = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), d + 4)
        q = unit(raw[:, :d].view(np.int8).astype(np.float32))
        error = np.ascontiguousarray(raw[:, d:]).view(np.float32).ravel()
        column = t.column("filters").combine_chunks()
        count, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
        owner = np.repeat(np.arange(len(t)), count)
        lists = np.full((len(t), int(count.max(initial=1))), -1, np.int32)
        lists[owner, np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)] = flat
        if group < 0:
            found = [(-1 - group, np.arange(len(t)), chunk if tile >> 15 != tile & 0x7FFF else None)]
        else:
            here = np.flatnonzero(group_of(flat, groups) == group)
            order = here[np.argsort(flat[here], kind="stable")]
            start = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
            found = [(int(flat[order[k]]), owner[order[k:end]], None) for k, end in zip(start, [*start[1:], len(order)], strict=True)]
            found = [x for x in found if (d, x[0]) not in hot]
        names, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, m, side in found:
            stays = entity[m[_may_link(q[m], error[m], lists[m], name, cosine, side)]]
            names.append(np.full(len(stays), name, np.int64))
            who.append(stays)
        names, who = np.concatenate(names), np.concatenate(who)
        return pa.table({"dim": pa.array(np.full(len(who), d, np.int32)), "entity": pa.array(who), "filter": pa.array(names)})

    return run


def _only(bits: np.ndarray):
    """Leaves out most entities that a filter of row ids does not hold."""

    @released
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(H.passes(bits, H.mix(b.column("entity").to_numpy().view(np.uint64).copy()))))

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def links(x: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x have the cosine or more with each other (a matrix; not with themselves)."""
    u = unit(x)
    c = u @ u.T
    found = c >= cosine
    for i, j in np.argwhere(np.triu(np.abs(c - cosine) < 1e-9, 1)):
        found[i, j] = found[j, i] = exact_cosine(x[i], x[j]) >= cosine
    np.fill_diagonal(found, False)
    return found


def earlier(lists: list[np.ndarray], name: int) -> np.ndarray:
    """Which members of a filter share one of a lower name (a matrix)."""
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    every = np.concatenate(lists)
    low = every < name
    names, at = np.unique(every[low], return_inverse=True)
    share = np.zeros((len(lists), max(1, len(names))), np.float32)
    share[who[low], at] = 1
    share = share[:, share.sum(axis=0) > 1]
    return share @ share.T > 0


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given as a matrix."""
    left, edges = linked.any(axis=1), []
    for first in range(len(linked)):
        if not left[first]:
            continue
        left[first] = False
        front = [first]
        while front:
            i = front.pop()
            j = np.flatnonzero(linked[i] & left)
            left[j] = False
            edges += [(i, int(k)) for k in j]
            front += j.tolist()
    return edges


def _tiles(cosine: float):
    """Rows (a, b, n) of a group of tiles: a's links, each counted as often as it has copies (b null), and edges."""

    @released_group
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key = [t.column(c).to_numpy() for c in ("right", "left", "filter", "dim")]
        order = np.lexsort(key)
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
        start = np.flatnonzero(new)
        entity, copies, chunk = (t.column(c).to_numpy() for c in ("entity", "copies", "chunk"))
        who, many, a, b = [], [], [], []
        for lo, hi in zip(start, [*start[1:], len(order)], strict=True):
            m = order[lo:hi]
            if hi - lo < 2:
                continue
            linked = links(matrix(t.column("vec").take(pa.array(m))), cosine)
            if key[0][m[0]] != key[1][m[0]]:
                linked &= chunk[m][:, None] != chunk[m][None, :]
            if not linked.any():
                continue
            lists = t.column("filters").take(pa.array(m)).combine_chunks()
            cut = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            linked &= ~earlier([flat[cut[i] : cut[i + 1]] for i in range(len(m))], key[2][m[0]])
            who.append(entity[m])
            many.append(linked @ copies[m])
            for i, j in forest(linked):
                a.append(entity[m[i]])
                b.append(entity[m[j]])
        who, many = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (who, many))
        names, at = np.unique(who, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, at, many)
        return pa.table({"a": pa.array([*names, *a], pa.int64()), "b": pa.array([None] * len(names) + b, pa.int64()), "n": pa.array([*total.tolist(), *[None] * len(a)], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (row id, vec_id, vec), a row each."""
    usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # Equal text is equal numbers: shortest forms that read back exactly.
    same = F.unhex(F.substring(F.sha2(F.col("vec").cast("string"), 256), 1, 32))
    rows = vectors.select(ROW, "vec_id", "vec", F.when(F.coalesce(usable, F.lit(False)), same).alias("same"))
    entities = stored(rows.where("same is not null").groupBy("same").agg(F.min(ROW).alias("entity"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.any_value("vec").alias("vec")).withColumn("dim", F.size("vec")), "entities")
    sizes = {r["dim"]: r["count"] for r in entities.groupBy("dim").count().collect()}  # a row a length
    plans = {d: plan(n, d, cosine) for d, n in sizes.items()}
    passed = stored(entities.select("dim", "entity", "vec").mapInArrow(_decode(plans), "dim int, entity long, filters array<int>, sketch binary"), "passed")
    many = passed.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").count().where(F.col("count") > SKETCHES)
    hot = {(r["dim"], r["filter"]): -(-r["count"] // SKETCHES) for r in many.collect()}  # a row for more than SKETCHES members
    groups = groups_for(sum(n * plans[d].keep * (d + 40) for d, n in sizes.items()), GROUP_BYTES)
    dealt = passed.mapInArrow(_deal(groups, hot), "group long, tile int, chunk int, dim int, entity long, filters array<int>, sketch binary")
    sifted = stored(dealt.groupBy("group", "tile", "dim").applyInArrow(_sift(cosine, groups, hot), "dim int, entity long, filter long").distinct(), "sifted")
    met = sifted.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).select("dim", "filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    hits = stored(sifted.join(met, ["dim", "filter"]).select("entity", "filter", "chunks"), "hits")
    size = hits.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0] * (8 * max(sizes, default=0) + 600)
    lists = hits.groupBy("entity").agg(F.collect_list(F.struct("filter", "chunks")).alias("hits"))  # as long as a vector's list
    near = entities.select("dim", "entity", "copies", "vec")
    near = near.mapInArrow(_only(row_filter(hits.select(F.col("entity").alias(ROW)))), near.schema)
    members = near.join(lists, "entity").select("dim", "entity", "copies", "vec", F.transform("hits", lambda h: h["filter"]).alias("filters"), F.explode("hits").alias("hit"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("entity"), F.col("hit.chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("hit.chunks") - 1)))
    tile = members.select("dim", F.col("hit.filter").alias("filter"), F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "entity", "copies", "vec", "filters")
    group = F.pmod(F.xxhash64("dim", "filter", "left", "right"), F.lit(groups_for(size, GROUP_BYTES)))
    found = stored(tile.withColumn("group", group).groupBy("group").applyInArrow(_tiles(cosine), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("entity")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b"))
    who = entities.select("same", "entity", "copies", "least").join(counts, "entity", "left").join(comp.withColumnRenamed("id", "entity"), "entity", "left").withColumn("component", F.coalesce("component", "entity"))
    least = who.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(who.join(least, "component").select("same", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "classes")
    for table in (passed, sifted, hits, found, comp, entities):
        dropped(table)
    every = rows.select("vec_id", "same").join(of, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_duplicates(with_row(df.select("vec_id", F.col("embedding").alias("vec"))))


#: All pairs, and the closure of their links.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT vec_id, vec_id AS z FROM v UNION SELECT e.y, r.z FROM r JOIN e ON e.x = r.vec_id),
m AS (SELECT vec_id, min(z) AS component_id FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""
