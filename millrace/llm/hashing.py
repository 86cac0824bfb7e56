"""numpy hashing of words and byte strings over whole Arrow batches.

A polynomial hash modulo 2**64 with an odd base: prefix sums of value[i] * B**i give the hash of
any substring by one subtraction and one product with B**-start, so all words (or all windows) of
a batch are hashed at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: Upper-case A-Z hash as lower-case.
VALUE_LOWER = VALUE.copy()
VALUE_LOWER[65:91] = VALUE[97:123]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words: space and bytes 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of a long text that are hashed together; more where distinct words count.
BLOCK, WIDE = 1 << 18, 1 << 20

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n at least; those of two blocks are kept between calls."""
    global _pow, _inv
    if n > 1 << 20:
        inv = pow(BASE, -1, 1 << 64)
        b, c = np.full(n, BASE, np.uint64), np.full(n, inv, np.uint64)
        b[0] = c[0] = 1
        return np.multiply.accumulate(b), np.multiply.accumulate(c)
    if len(_pow) < n:
        size = max(n, 1 << 19)
        inv = pow(BASE, -1, 1 << 64)
        b, c = np.full(size, BASE, np.uint64), np.full(size, inv, np.uint64)
        b[0] = c[0] = 1
        _pow, _inv = np.multiply.accumulate(b), np.multiply.accumulate(c)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of h (uint64), in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def prefix(b: np.ndarray, value: np.ndarray = VALUE) -> np.ndarray:
    g = np.empty(len(b) + 1, np.uint64)
    g[0] = 0
    np.cumsum(value[b] * powers(len(b) + 1)[0][: len(b)], out=g[1:])
    return g


def span_hash(g: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start to end (exclusive), the same wherever the bytes stand."""
    return mix((g[end] - g[start]) * powers(len(g))[1][start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, first 0) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(off: np.ndarray, size: int = 1 << 18):
    """Ranges of texts of about size bytes together, a longer text alone: work that stays in cache."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def bits_of(h: np.ndarray, size: int) -> np.ndarray:
    """Two bits of a filter of size bits for each hash."""
    return np.concatenate([h % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)]).astype(np.int64).reshape(2, -1)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter (uint64 cells): all that are, and some others."""
    a, b = bits_of(h, 64 * len(bits))
    return ((bits[a >> 6] >> (a & 63).astype(np.uint64)) & (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def cells(h: np.ndarray, size: int) -> pa.RecordBatch:
    """(cell, mask) rows that set the bits of hashes."""
    at = bits_of(h, size).ravel()
    return pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["cell", "mask"])


def parts_of_batch(b: pa.RecordBatch, column: str, size: int):
    """Slices of a batch whose texts have about size bytes together; a longer text is one alone."""
    at = b.schema.get_field_index(column)
    cell = b.column(at)
    ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(cell).to_numpy(zero_copy_only=False))) if len(b) else np.zeros(0)
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
        yield b.slice(i, j - i)
        i = j


#: Separators where punctuation counts as such too: all ASCII but letters and digits.
NOT_LETTER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_spans(b: np.ndarray, cut: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of b; a word ends at a separator or at a text's end (cut: offsets)."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = between[b]
    first = np.empty(len(b), bool)
    first[0] = True
    first[1:] = s[:-1]
    inner = cut[(cut > 0) & (cut < len(b))]
    first[inner] = True
    last = np.empty(len(b), bool)
    last[-1] = True
    last[:-1] = s[1:]
    last[inner - 1] = True
    word = ~s
    return np.flatnonzero(first & word), np.flatnonzero(last & word) + 1


def spelled(b: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """The words between starts and ends, in order and apart, with A-Z lowered."""
    edge = np.zeros(len(b) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    low = LOWER[b[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]]
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(off), pa.py_buffer(low)])


def digests(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2 of each word: no words are known that share them. The polynomial hashes above are
    linear in the bytes, so that long words can be made to agree; they serve where that costs nothing but
    a candidate or a feature. Each distinct word is hashed once."""
    word = spelled(b, start, end).dictionary_encode()
    each = b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in word.dictionary.to_pylist()])
    return np.frombuffer(each, np.uint64)[word.indices.to_numpy()]


def polynomial(value: np.ndarray):
    return lambda b, start, end: span_hash(prefix(b, value), start, end)


def words(data: np.ndarray, off: np.ndarray, hashed=polynomial(VALUE_LOWER), between: np.ndarray = IS_SPACE, block: int = BLOCK):
    """Yields (first text, last text + 1, word hashes, words up to each text) for runs of texts. A text
    of more than two blocks is hashed in blocks that end between words. hashed: (bytes, starts, ends) to hashes."""
    for i, j in chunks(off, block):
        if j == i + 1 and off[j] - off[i] > 2 * block:
            b, at, h = data[off[i] : off[j]], 0, []
            while at < len(b):
                to = min(len(b), at + block)
                while to < len(b):  # no separator in a block: the word goes on
                    gap = np.flatnonzero(between[b[to : to + block]])
                    to = min(len(b), to + (int(gap[0]) if len(gap) else block))
                    if len(gap):
                        break
                part = b[at:to]
                start, end = word_spans(part, np.array([0, len(part)]), between)
                if len(start):
                    h.append(hashed(part, start, end))
                at = to
            h = np.concatenate([np.zeros(0, np.uint64), *h])
            yield i, j, h, np.array([0, len(h)])
            continue
        b, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end = word_spans(b, cut, between)
        h = hashed(b, start, end) if len(start) else np.zeros(0, np.uint64)
        yield i, j, h, np.searchsorted(start, cut)


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words within a text and the text of each; a text of fewer words
    (but some) has one run, of all its words. at: words up to each text."""
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    if not len(h):
        return h, text
    pos = np.arange(len(h)) - at[:-1][text]
    size = np.minimum(n, count)[text]
    full = pos + size <= count[text]
    i = np.flatnonzero(full)
    out = np.full(len(i), 0x51ED270B, np.uint64)
    k = size[i]
    for d in range(n):
        inside = d < k
        if inside.all():
            out = mix(out * np.uint64(BASE) + h[i + d])
        else:
            out[inside] = mix(out[inside] * np.uint64(BASE) + h[i[inside] + d])
    return out, text[i]


def planes(a: np.ndarray) -> bytes:
    """The bytes of a, first bytes of all numbers first: equal high bytes lie together and compress well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences, in planes."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)
