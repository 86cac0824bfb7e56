"""N-gram Jaccard join: links documents whose shingle sets have similarity t or more, exactly.

1. Equal sets are one entity from the start, so copies never meet as pairs.
2. Entities meet in tiles. A size band spans sizes of ratio t, so a link stays in a band or its
   neighbour. Two linked sets differ in at most d shingles, d known per band; shingles are dealt
   into d + SPARE parts by hash, so linked sets agree in SPARE parts at least. A tile is (band, part,
   sum of the part's hashes); an entity joins the tiles of its parts that are not empty, and those of
   empty parts only if it has SPARE of them or more. A frequent shingle alone does not make a tile:
   all shingles of the part must agree.
3. In a tile, parity bitmaps bound the overlap from above: sets differ in as many shingles at
   least as their bitmaps in bits. Pairs that pass form a graph, of which a spanning forest is kept.
4. Each component of that graph holds every link of its members. Its texts are brought together
   once and links are tested by intersecting sorted arrays, in order of size, skipping pairs that
   are connected already. These arrays number the shingles by their bytes, not by hashes. Words
   are hashed by 64 bits of BLAKE2 before that.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing (its component is its own id); a text of fewer words than the shingle has one shingle;
repeated rows are returned each; other columns are dropped, so none can clash; an empty table
gives an empty table. A component's id is its least doc_id (nulls aside).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .base import ROW, documents, dropped, fixed, groups_for, keyed_text, released, released_group, row_filter, ship, squeezed, stored, text_bytes, unsqueezed
from .components import components

#: Parts beyond the most that can differ.
SPARE = 3
#: Tile keys gathered by a task before they are written out.
FLUSH = 1_000_000
#: Text bytes for each group that tile keys are dealt into, and for each group of components.
TILE_BYTES, TEXT_BYTES = 16 << 20, 24 << 20
#: Compressed bytes of text whose shingles are numbered together, where a component is not larger.
PART_BYTES = 512 << 10


def band_of(size: int, percent: int) -> int:
    return int(math.log(size) / -math.log(percent / 100) + 1e-9)


@lru_cache(maxsize=None)
def parts_of(band: int, percent: int) -> int:
    """Parts for sets of a band and the one below."""
    t = percent / 100
    largest = 1
    lo = math.exp((band + 1) * -math.log(t))
    largest = int(lo) + 1
    while band_of(largest, percent) > band and largest > 1:
        largest -= 1
    return int((1 - t) / (1 + t) * 2 * largest + 1e-9) + SPARE


def width_of(size: int) -> int:
    """Bits of a set's bitmap: a power of two, as many as its shingles at least."""
    return max(512, 1 << (size - 1).bit_length())


def bitmap(h: np.ndarray) -> bytes:
    """Parity bitmap: bit b is set if an odd number of hashes fall on it."""
    w = width_of(len(h))
    odd = np.bincount((h % np.uint64(w)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(b: bytes, bits: int) -> np.ndarray:
    """A bitmap at fewer bits (parity bitmaps fold by exclusive or), as uint64 words."""
    a = np.frombuffer(b, np.uint64)
    return np.bitwise_xor.reduce(a.reshape(-1, bits // 64), axis=0)


def sets(data: np.ndarray, off: np.ndarray, n: int):
    """Ascending distinct shingle hashes of each text."""
    for i, j, h, at in H.words(data, off, H.digests, block=H.WIDE):
        s, owner = H.shingles(h, at, n)
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(s[cut[k] : cut[k + 1]])


def exact_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Ascending distinct shingles of each text as numbers that stand for their words' bytes within these texts:
    no hashes, so unlike shingles have unlike numbers."""
    start, end = H.word_spans(data, off)
    word = H.spelled(data, start, end).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    at = np.searchsorted(start, off)
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    left = at[1:][text] - np.arange(len(word))  # words up to the text's end
    run = word
    for d in range(1, n):  # a text of fewer words is followed by 0s
        after = np.zeros(len(word), np.int64)
        after[: max(0, len(word) - d)] = word[d:]
        after[left <= d] = 0
        run = np.unique(run * (int(word.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)
    full = (left >= n) | ((count[text] < n) & (left == count[text]))
    cut = np.searchsorted(np.flatnonzero(full), at)
    run = run[full].astype(np.uint64)
    return [np.unique(run[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def entity_of(h: np.ndarray) -> int:
    """Identity of a set: a hash of all its members, whatever their order."""
    return int(H.mix(H.mix(h.copy()).sum(keepdims=True) + np.uint64(len(h)))[0].view(np.int64))


def tile_keys(h: np.ndarray, percent: int) -> np.ndarray:
    b = band_of(len(h), percent)
    spread = H.mix(h + np.uint64(77))
    place, low, high = spread >> np.uint64(20), (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), (spread >> np.uint64(32)).astype(np.float64)
    out = []
    for band in (b, b + 1):
        k = parts_of(band, percent)
        part = (place % np.uint64(k)).astype(np.int64)
        # Sums of halves stay below 2**53 up to two million shingles in a part; they wrap alike beyond.
        s = np.bincount(part, low, k).astype(np.uint64) + (np.bincount(part, high, k).astype(np.uint64) << np.uint64(32))
        full = np.bincount(part, minlength=k) > 0
        use = np.ones(k, bool) if k - full.sum() >= SPARE else full
        i = np.flatnonzero(use).astype(np.uint64)
        out.append(H.mix(H.mix(s[use] + i * np.uint64(H.BASE)) + np.uint64(band * 2654435761 + k)))
    return np.concatenate(out)


def _describe(df: DataFrame, n: int, percent: int, groups: int) -> DataFrame:
    """Rows of documents (group -1: their entity, size and bitmap) and of tile keys (by group)."""

    @released
    def run(batches):
        keys, owners, ids, held = [], [], [], 0
        names = ["group", ROW, "doc_id", "size", "entity", "bits", "keys", "owners"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def flush():
            k, o, e = np.concatenate(keys), np.repeat(np.arange(len(ids)), owners), np.array(ids, np.int64)
            g = (k % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((k, g))
            k, o, g = k[order], o[order], g[order]
            cut = np.searchsorted(g, np.arange(groups + 1))
            rows = []
            for p in range(groups):
                if cut[p] < cut[p + 1]:
                    here, local = np.unique(o[cut[p] : cut[p + 1]], return_inverse=True)
                    rows.append((p, None, None, None, None, H.planes(e[here]), H.pack_sorted(k[cut[p] : cut[p + 1]]), H.planes(local.astype(np.uint32))))
            return table(rows)

        for b in batches:
            rows = []
            data, off = H.buffers(b.column("text"))
            for r, d, h in zip(b.column(ROW).to_pylist(), b.column("doc_id").to_pylist(), sets(data, off, n), strict=True):
                if not len(h):
                    rows.append((-1, r, d, 0, None, None, None, None))
                    continue
                e = entity_of(h)
                rows.append((-1, r, d, len(h), e, bitmap(h), None, None))
                t = tile_keys(h, percent)
                keys.append(t)
                owners.append(len(t))
                ids.append(e)
                held += len(t)
            if rows:
                yield table(rows)
            if held > FLUSH:
                yield flush()
                keys, owners, ids, held = [], [], [], 0
        if held:
            yield flush()

    return df.mapInArrow(run, f"group int, {ROW} long, doc_id long, size long, entity long, bits binary, keys binary, owners binary")


@released_group
def _meet(t: pa.Table) -> pa.Table:
    """Tiles of a group of keys with two entities or more, each set of members once."""
    key, who = [], []
    for e, k, o in zip(t.column("bits").to_pylist(), t.column("keys").to_pylist(), t.column("owners").to_pylist(), strict=True):
        key.append(H.unpack_sorted(k))
        who.append(H.unplanes(e, np.int64)[H.unplanes(o, np.uint32)])
    key, who = np.concatenate(key), np.concatenate(who)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])  # copies of an entity
    key, who = key[new], who[new]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(start, append=len(key))
    mark = np.add.reduceat(H.mix(who.view(np.uint64).copy()), start)
    many = np.flatnonzero(count > 1)
    many = many[np.unique(mark[many], return_index=True)[1]]
    take = np.repeat(start[many], count[many]) + np.arange(count[many].sum()) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
    return pa.table({"tile": pa.array(np.repeat(mark[many].view(np.int64), count[many])), "entity": pa.array(who[take])})


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        r = self.root
        while r[i] != i:
            r[i] = r[r[i]]
            i = r[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        r = self.root
        while (r[r] != r).any():
            r = r[r]
        self.root = r
        return r


def passes(a: np.ndarray, size_a: int, b: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the bitmaps b may belong to sets linked with that of a: most overlap against least needed."""
    differ = np.bitwise_count(b ^ a).sum(axis=1, dtype=np.int64)
    most = (size_a + size_b - differ) // 2
    return 100 * most >= percent * (size_a + size_b - most)


def _forest(size: np.ndarray, bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of a tile that pass; each search step tests one
    bitmap against those not reached yet."""
    w = 8 * min(map(len, bits))
    b = np.stack([fold(x, w) for x in bits])
    order = np.argsort(size, kind="stable")
    b, s = b[order], size[order]
    left = np.ones(len(s), bool)
    edges, front = [], []
    for first in range(len(s)):
        if not left[first]:
            continue
        left[first] = False
        front = [first]
        while front:
            i = front.pop()
            lo, hi = np.searchsorted(s, [-(-s[i] * percent // 100), s[i] * 100 // percent + 1])
            j = lo + np.flatnonzero(left[lo:hi])
            j = j[passes(b[i], int(s[i]), b[j], s[j], percent)] if len(j) else j
            left[j] = False
            edges += [(int(order[i]), int(order[k])) for k in j]
            front += j.tolist()
    return edges


def _tiles(percent: int):
    @released_group
    def run(t: pa.Table) -> pa.Table:
        tile, entity, size = (t.column(c).to_numpy() for c in ("tile", "entity", "size"))
        bits = t.column("bits").to_pylist()
        order = np.argsort(tile, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(tile[order]) != 0])
        names, at = np.unique(entity, return_inverse=True)
        seen, a, b = Sets(len(names)), [], []
        for k, end in zip(start, [*start[1:], len(order)], strict=True):
            m = order[k:end]
            for i, j in _forest(size[m], [bits[x] for x in m], percent):
                i, j = at[m[i]], at[m[j]]
                if seen.join(i, j):
                    a.append(names[i])
                    b.append(names[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test on two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _connect(comp: np.ndarray, entity: np.ndarray, arrays: list[np.ndarray], percent: int) -> np.ndarray:
    """The label of each entity: the first one of those that it is linked with, within its component."""
    size = np.array([len(x) for x in arrays])
    label = entity.copy()
    order = np.lexsort((entity, size, comp))
    start = np.flatnonzero(np.r_[True, np.diff(comp[order]) != 0])
    for k, end in zip(start, [*start[1:], len(order)], strict=True):
        m = order[k:end]
        s = size[m]
        maps = [bitmap(H.mix(arrays[x].copy())) for x in m]
        w = 8 * min(map(len, maps))
        b, u = np.stack([fold(x, w) for x in maps]), Sets(len(m))
        for i in range(len(m)):
            j = i + 1 + np.flatnonzero(u.roots()[i + 1 :] != u.root[i])
            j = j[s[j] * percent <= 100 * s[i]]
            if len(j):
                for q in j[passes(b[i], int(s[i]), b[j], s[j], percent)]:
                    if u.find(i) != u.find(q) and linked(arrays[m[i]], arrays[m[q]], percent):
                        u.join(i, q)
        label[m] = entity[m][u.roots()]
    return label


def _exact(n: int, percent: int):
    """Components of a group are independent: whole ones are taken together up to PART_BYTES of compressed text."""

    @released_group
    def run(t: pa.Table) -> pa.Table:
        t = t.select(["component", "entity", "z"]).sort_by("component").combine_chunks()
        comp, entity = t.column("component").to_numpy(), t.column("entity").to_numpy()
        upto = np.cumsum(pa.compute.binary_length(t.column("z")).to_numpy())
        ends = np.flatnonzero(np.r_[comp[1:] != comp[:-1], True]) + 1
        label, lo = entity.copy(), 0
        while lo < len(comp):
            most = (upto[lo - 1] if lo else 0) + PART_BYTES
            whole = ends[(ends > lo) & (upto[ends - 1] <= most)]
            hi = int(whole[-1]) if len(whole) else int(ends[ends > lo][0])
            data, off = H.buffers(unsqueezed(t.column("z").slice(lo, hi - lo)))
            label[lo:hi] = _connect(comp[lo:hi], entity[lo:hi], exact_sets(data, off, n), percent)
            lo = hi
        return pa.table({"entity": pa.array(entity), "label": pa.array(label)})

    return run


def join(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(row id, doc_id, size, label, component_id) of (row id, doc_id, text). Linked rows share a label,
    whatever their doc_ids; it is null where the set is empty."""
    total = text_bytes(docs)
    tile_groups, text_groups = groups_for(total, TILE_BYTES), groups_for(total, TEXT_BYTES)
    d = stored(_describe(docs, n, percent, tile_groups), "described")
    doc = d.where("group = -1").select(ROW, "doc_id", "size", "entity", "bits")
    keys = d.where("group >= 0").select("group", "bits", "keys", "owners")
    tiles = keys.groupBy("group").applyInArrow(_meet, "tile long, entity long").distinct()
    maps = doc.where("entity is not null").groupBy("entity").agg(F.min(F.struct(ROW, "size", "bits")).alias("r")).select("entity", "r.*")
    met = tiles.join(maps, "entity").select(F.pmod(F.xxhash64("tile"), F.lit(tile_groups)).alias("group"), "tile", "entity", "size", "bits")
    edges = met.groupBy("group").applyInArrow(lambda t: _tiles(percent)(t), "a long, b long")
    comp = components(edges)
    reps = comp.join(maps.select("entity", ROW), comp["id"] == maps["entity"]).select(ROW, "entity", "component")
    texts = squeezed(docs.select(ROW, "text"), only=row_filter(reps)).join(reps, ROW)
    dealt = texts.select(F.pmod(F.xxhash64("component"), F.lit(text_groups)).alias("group"), "component", "entity", "z")
    labels = stored(dealt.groupBy("group").applyInArrow(lambda t: _exact(n, percent)(t), "entity long, label long"), "labels")
    found = doc.join(labels, "entity", "left").select(ROW, "doc_id", "size", F.coalesce("label", "entity").alias("label"))
    least = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = stored(found.join(least, "label", "left").select(ROW, "doc_id", "size", "label", F.coalesce("least", "doc_id").alias("component_id")), "linked")
    for table in (d, comp, labels):
        dropped(table)
    return out


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(keyed_text(documents(spark, sf_dir)), 4, 85).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays: that of the least doc_id, of equal ones the first row."""
    ship(spark)
    d = fixed(docs).select(F.struct(*docs.columns).alias("doc"), "doc_id", "text").withColumn(ROW, F.monotonically_increasing_id())
    found = join(d.select(ROW, "doc_id", F.coalesce("text", F.lit("")).alias("text")), n, percent)
    group = F.struct(F.when(F.col("label").isNull(), F.col(ROW)).otherwise(F.lit(-1)), "label")
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("r"))
    keep = stored(first.select(F.col(f"r.{ROW}").alias(ROW)), "kept")
    bits = row_filter(found.join(keep, ROW, "left_anti"))
    # Rows that surely stay do not move; only what the filter of dropped ids holds is joined, exactly.
    sure, unsure = (d.select(ROW, "doc").mapInArrow(_dropped(bits, held), d.select(ROW, "doc").schema) for held in (False, True))
    return sure.select("doc.*").unionByName(unsure.join(keep, ROW, "left_semi").select("doc.*"))


def _dropped(bits: np.ndarray, held: bool):
    """Rows whose ids the filter holds, or the others."""

    @released
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(H.passes(bits, H.mix(b.column(ROW).to_numpy().view(np.uint64).copy())) == held))

    return run


#: op9_jaccard in SQL: all pairs that share a shingle, and the closure of their links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT e.y, r.z FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""
