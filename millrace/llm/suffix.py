"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts elsewhere too.

The suffix order of a collection of strings is built column by column: round r inserts the suffix
of length r of every string into the collection's Burrows-Wheeler transform, one symbol a string,
and updates the common prefixes of neighbours (`build`). A round reads the columns in order and
writes them anew; beyond EXTERNAL symbols they are files. A string of LENGTH bytes repeats
if its suffix shares LENGTH symbols with a neighbour in the order.

One collection of a whole corpus would need as many rounds as the longest text has bytes, each
over all of it. So the corpus becomes many collections of short strings, with nothing lost: of the
hashes of the inner strings of GRAM bytes in a window of LENGTH bytes, the least is the window's
anchor. Equal windows have equal anchors. A text falls into segments, maximal runs of windows of one
anchor, and a collection holds the distinct segments of an anchor. A segment that occurs twice
repeats wholly; an anchor of one segment that occurs once has no repeats; all others are built.
An anchor of more than SPLIT distinct segments is split by what stands to its left and to its
right: of two equal windows, FLANK bytes on one side at least agree.

Defined results: a null text is empty, nothing is removed from it; matches never cross texts;
texts shorter than LENGTH lose nothing; of equal rows each loses the bytes that it shares; a
very long text is cut into segments in one task, with some 50 bytes held for each of its own; other
columns are dropped, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .base import ROW, documents, dropped, fixed, groups_for, keyed_text, released, released_group, ship, slices, squeezed, stored

LENGTH = 200
#: Segments of a batch that is built together, groups whole.
BATCH = 320
#: Symbols from which the columns of a build are kept in files.
EXTERNAL = 8 << 20
SPLIT = 4096
#: Segments for each group of builds.
TASK_SEGMENTS = 20_000


def shape(length: int) -> tuple[int, int, int]:
    """(windows of an anchor at most, a power of two; GRAM; FLANK) for a length."""
    w = 1 << max(0, (length * 2 // 3).bit_length() - 1)
    gram = length - w + 1
    return w, gram, (length - gram + 1) // 2


def segments(data: np.ndarray, off: np.ndarray, length: int):
    """Yields (texts, starts in the text, sizes, anchors, segment hashes, anchor places in the segment)."""
    w, gram, _ = shape(length)
    for i, j in H.chunks(off):
        b, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
        n = len(b)
        if n < length:
            continue
        g = H.prefix(b)
        m = n - gram + 1
        h = (g[gram:] - g[:m]) * H.powers(n + 1)[1][:m]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(32)
        h <<= np.uint64(32)
        h |= np.arange(m, dtype=np.uint64)
        step = 1
        while step < w:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        count = np.diff(cut) - length + 1  # windows of each text
        some = np.flatnonzero(count > 0)
        text = np.repeat(some, count[some])
        at = np.arange(len(text)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + cut[text]
        place = (h[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(place):
            continue
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[first[1:], len(place)] - 1
        start, end, anchor = at[first], at[last] + length, place[first]
        yield i + text[first], start - cut[text[first]], end - start, H.span_hash(g, anchor, anchor + gram), H.span_hash(g, start, end), anchor - start


class Columns:
    """The two columns of a build: arrays, or beyond EXTERNAL symbols files that each round reads and
    writes from front to back."""

    def __init__(self, size: int):
        self.folder = tempfile.TemporaryDirectory() if size > EXTERNAL else None
        self.turn = 0

    def put(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.turn ^= 1
        if self.folder:
            bwt.tofile(os.path.join(self.folder.name, f"bwt{self.turn}"))
            lcp.tofile(os.path.join(self.folder.name, f"lcp{self.turn}"))
        else:
            self.held = bwt, lcp

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.folder:
            return tuple(np.fromfile(os.path.join(self.folder.name, f"{k}{self.turn}"), t) for k, t in (("bwt", np.uint8), ("lcp", np.uint16)))
        return self.held

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def _least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low + 1 .. high]) of each pair: by falling low, so that only these ranges are read."""
    order = np.argsort(-low, kind="stable")
    pair = np.empty(2 * len(low), np.int64)
    pair[::2], pair[1::2] = low[order] + 1, high[order] + 1
    out = np.empty(len(low), lcp.dtype)
    out[order] = np.minimum.reduceat(lcp, pair)[::2]
    return out


def build(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(Burrows-Wheeler transform, common prefixes) of a collection; end marks are symbol 0, the
    earlier string's first. The last entry of the prefixes is a stop."""
    m, size = len(strings), np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.zeros(256, np.uint8)
    used[np.unique(flat)] = 1
    if used.all():
        raise ValueError("a collection may use 255 byte values")
    code = np.cumsum(used, dtype=np.int64).astype(np.uint8)
    back = np.zeros((int(size.max(initial=0)) + 1, m), np.uint8)  # symbols from the end, by round
    ends = np.cumsum(size)
    for i in range(m):
        back[: size[i], i] = code[flat[ends[i] - size[i] : ends[i]]][::-1]
    columns = Columns(int(size.sum()) + m)
    columns.put(back[0].copy(), np.zeros(m + 1, np.uint16))
    place = np.arange(m)
    for r in range(1, len(back)):
        active = np.flatnonzero(back[r - 1])
        bwt, lcp = columns.get()
        n, done = len(bwt), m - len(active)
        order = np.argsort(bwt, kind="stable")
        owner = np.full(n, -1, np.int32)
        owner[place[active]] = active
        who = owner[order]
        k = np.flatnonzero(who >= 0)
        who = who[k]
        here = order[k]
        symbol = bwt[here]
        low = order[np.maximum(k - 1, 0)]
        high = order[np.minimum(k + 1, n - 1)]
        has_low = (k > 0) & (bwt[low] == symbol)
        has_high = (k + 1 < n) & (bwt[high] == symbol)
        to = m + k - done
        keep = np.ones(n + len(active), bool)
        keep[to] = False
        new_bwt = np.empty(len(keep), np.uint8)
        new_bwt[keep] = bwt
        new_bwt[to] = back[r][who]
        new_lcp = np.zeros(len(keep) + 1, np.uint16)
        new_lcp[:-1][keep] = lcp[:-1]
        new_lcp[to] = 0
        if has_low.any():
            new_lcp[to[has_low]] = 1 + _least_between(lcp, low[has_low], here[has_low])
        if has_high.any():
            new_lcp[to[has_high] + 1] = 1 + _least_between(lcp, here[has_high], high[has_high])
        columns.put(new_bwt, new_lcp)
        place[who] = to
    bwt, lcp = columns.get()
    columns.close()
    return bwt, lcp


def repeats(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of `length` bytes start elsewhere in the collection too."""
    m, size = len(strings), np.array([len(s) for s in strings])
    bwt, lcp = build(strings)
    order = np.argsort(bwt, kind="stable")
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    hit = np.maximum(lcp[:-1], lcp[1:]) >= length
    at = np.arange(m)
    out = np.zeros((m, int(size.max()) + 1), bool)
    for r in range(1, int(size.max()) + 1):
        live = np.flatnonzero(size >= r)
        at[live] = to[at[live]]
        out[live, size[live] - r] = hit[at[live]]
    return [out[i, : max(0, size[i] - length + 1)] for i in range(m)]


def runs(flags: np.ndarray) -> np.ndarray:
    """(start, end) of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def covered(flags: np.ndarray, length: int) -> np.ndarray:
    """(start, end) of the bytes that the flagged windows cover."""
    r = runs(flags)
    if not len(r):
        return r
    r = r + np.array([0, length - 1])
    gap = r[1:, 0] > r[:-1, 1]
    return np.stack([r[np.r_[True, gap], 0], r[np.r_[gap, True], 1]], 1)


def _emit_segments(docs: DataFrame, length: int) -> DataFrame:
    @released
    def run(batches):
        for b in batches:
            data, off = H.buffers(b.column("text"))
            row = b.column(ROW).to_numpy(zero_copy_only=False)
            for text, start, size, anchor, seg, place in segments(data, off, length):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[text]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int16)), pa.array(place.astype(np.int16)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))],
                    [ROW, "start", "size", "place", "anchor", "seg"],
                )

    return docs.select(ROW, "text").mapInArrow(run, f"{ROW} long, start int, size short, place short, anchor long, seg long")


def _cut_out(length: int):
    """Bytes of the wanted segments of each text, by the group that they are built in."""
    _, gram, flank = shape(length)

    @released
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in (c for whole in batches for c in slices(whole)):
            rows = []
            for raw, wanted in zip(b.column("z").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                text = z.decompress(raw) if raw else b""
                for x in wanted:
                    s = text[x["start"] : x["start"] + x["size"]]
                    groups = [x["anchor"]]
                    if x["split"]:
                        p, q = x["place"], x["place"] + gram
                        groups = [k for side, k in ((p >= flank, s[p - flank : p + gram] + b"<"), (len(s) - q >= flank, s[p : q + flank] + b">")) if side]
                        groups = [int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in groups]
                    rows += [(k, x["anchor"], x["seg"], x["once"], s) for k in groups]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = ["build", "anchor", "seg", "once", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    return run


def _build_group(length: int):
    @released_group
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("build")
        key, once = t.column("build").to_numpy(), t.column("once").to_numpy()
        names = np.stack([t.column("anchor").to_numpy(), t.column("seg").to_numpy()], 1)
        strings = t.column("bytes").to_pylist()
        start = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        end = np.r_[start[1:], len(key)]
        take, a, b = [], [], []
        k = 0
        while k < len(start):
            j = k + 1
            while j < len(start) and end[j] - start[k] <= BATCH:
                j += 1
            # A segment of a split anchor is in two builds; where a batch holds both, one copy stands for it.
            batch = start[k] + np.sort(np.unique(names[start[k] : end[j - 1]], axis=0, return_index=True)[1])
            for i, flags in zip(batch, repeats([strings[i] for i in batch], length), strict=True):
                if once[i]:
                    for s, e in covered(flags, length):
                        take.append(i)
                        a.append(int(s))
                        b.append(int(e))
            k = j
        found = t.select(["anchor", "seg"]).take(pa.array(take, pa.int64()))
        return found.append_column("from", pa.array(a, pa.int32())).append_column("to", pa.array(b, pa.int32()))

    return run


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row id, spans), a stored table: (start, end) bytes of each text to remove, in no order and maybe
    overlapping; texts without any are left out."""
    every = _emit_segments(docs, length)
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor")
    met = stored(every.join(again, "anchor"), "segments")
    kinds = met.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(ROW, "start", "size", "place")).alias("r"))
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = stored(kinds.join(per, "anchor").select("anchor", "seg", "n", "kinds", "r.*"), "kinds")
    mixed = kinds.where("kinds > 1")
    tasks = groups_for(mixed.count(), TASK_SEGMENTS)
    want = F.struct("anchor", "seg", (F.col("n") == 1).alias("once"), "start", "size", "place", (F.col("kinds") > SPLIT).alias("split"))
    wanted = mixed.groupBy(ROW).agg(F.collect_list(want).alias("wanted"))
    pieces = squeezed(docs).join(wanted, ROW).select("z", "wanted").mapInArrow(_cut_out(length), "build long, anchor long, seg long, once boolean, bytes binary")
    dealt = pieces.groupBy(F.pmod(F.xxhash64("build"), F.lit(tasks)).alias("task"))
    run = _build_group(length)
    built = dealt.applyInArrow(lambda t: run(t.drop_columns(["task"]) if "task" in t.column_names else t), "anchor long, seg long, from int, to int")
    whole = kinds.where("n > 1").select("anchor", "seg", F.lit(0).alias("from"), F.col("size").cast("int").alias("to"))
    hit = met.join(whole.unionByName(built), ["anchor", "seg"])
    span = F.struct((F.col("start") + F.col("from")).alias("s"), (F.col("start") + F.col("to")).alias("e"))
    out = stored(hit.select(ROW, span.alias("span")).groupBy(ROW).agg(F.collect_list("span").alias("spans")), "spans")
    dropped(met)
    dropped(kinds)
    return out


def merged(found: list | None) -> list[tuple[int, int]]:
    """Spans in order; those that touch become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def rest(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in cut:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_text(documents(spark, sf_dir))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    @released
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in (c for whole in batches for c in slices(whole)):
            out = []
            for raw, found in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text, cut = z.decompress(raw), merged(found)
                out.append((len(text), sum(e - s for s, e in cut), len(cut), hashlib.sha256(rest(text, cut)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True))], names)

    return squeezed(docs, "doc_id").join(spans(docs), ROW, "left").select("doc_id", "z", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """Takes the repeated bytes out of every text. A character cut in two goes; n_chars follows."""
    ship(spark)
    d = fixed(docs).select(F.struct(*docs.columns).alias("doc"), "text").withColumn(ROW, F.monotonically_increasing_id())
    found = spans(d.select(ROW, F.coalesce("text", F.lit("")).alias("text")), length)

    @released
    def run(batches):
        for b in (c for whole in batches for c in slices(whole)):
            kept = [x if x is None or not s else rest(x.encode(), merged(s)).decode("utf-8", "ignore") for x, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(kept, pa.string())], ["doc", "text"])

    joined = d.join(found, ROW, "left").select("doc", "text", "spans")
    done = joined.mapInArrow(run, joined.select("doc", "text").schema)
    parts = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        parts["n_chars"] = F.when(F.col("text").isNull(), F.col("doc.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(parts[c].alias(c) for c in docs.columns))
