"""Media columns: texts or other bytes kept as PNG images in binary columns, read back and hashed.

`encode` and `decode` work on bytes; `attach_media` and `media_features` on DataFrames. A PNG
here has 8-bit RGB samples, WIDTH pixels a row, so a payload is a whole number of 192-byte rows.

Defined results: a null text is empty; an empty text becomes one row of spaces; equal payloads
give equal media and features; a damaged chunk raises ValueError; a very long
text is one image, with the payload held a few times in its task; input columns other than those
named are dropped, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import documents, keyed_text, released

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SAMPLES = 64, 3
STRIDE = WIDTH * SAMPLES


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes, unit: int = STRIDE) -> bytes:
    """data with spaces appended up to a positive multiple of unit."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """PNG of a payload of whole rows. Each row takes the filter (none or up) with the smaller sum of
    absolute differences."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = lambda a: np.minimum(a, -a).sum(axis=1, dtype=np.int64)
    use_up = cost(up) < cost(rows)
    lines = np.empty((len(rows), STRIDE + 1), np.uint8)
    lines[:, 0] = np.where(use_up, 2, 0)
    lines[:, 1:] = np.where(use_up[:, None], up, rows)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk; ValueError if a length or checksum does not hold."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(data) != size or at + 12 + size > len(png):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r} does not match")
        yield kind, data
        at += 12 + size


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered scan lines (filter byte first). Runs of rows of filters none and up are
    summed down the columns at once; sub is a sum along the row; average and Paeth go pixel by pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    i, n = 0, len(out)
    while i < n:
        k = kinds[i]
        if k in (0, 2):
            j = i + 1
            while j < n and kinds[j] == 2:
                j += 1
            if k == 2 and i:
                out[i] += out[i - 1]
            np.add.accumulate(out[i:j], axis=0, out=out[i:j], dtype=np.uint8)
            i = j
            continue
        above = out[i - 1] if i else np.zeros_like(out[i])
        if k == 1:
            row = out[i].reshape(-1, step)
            out[i] = np.add.accumulate(row, axis=0, dtype=np.uint8).ravel()
        else:
            row = out[i].astype(np.int64)
            up = above.astype(np.int64)
            for x in range(0, len(row), step):
                left = row[x - step : x] if x else np.zeros(step, np.int64)
                corner = up[x - step : x] if x else np.zeros(step, np.int64)
                here = up[x : x + step]
                if k == 3:
                    guess = (left + here) // 2
                else:
                    p = left + here - corner
                    a, b, c = abs(p - left), abs(p - here), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, here, corner))
                row[x : x + step] = (row[x : x + step] + guess) & 255
            out[i] = row.astype(np.uint8)
        i += 1
    return out


def decode(png: bytes) -> np.ndarray:
    """Samples (height, width * samples) of an 8-bit gray, RGB or RGBA PNG without interlace."""
    head, data = None, []
    for kind, part in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit gray, RGB and RGBA without interlace are read")
    step = {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != head[1] * (head[0] * step + 1):
        raise ValueError("the image data has the wrong size")
    return unfilter(raw.reshape(head[1], -1), step)


SIDE, LOW = 32, 8
_k = np.arange(SIDE)
#: The first LOW rows of the cosine transform of SIDE samples.
COSINES = np.sqrt(2 / SIDE) * np.cos(np.pi * (2 * _k[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
COSINES[0] /= np.sqrt(2)


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """Means over n bands of rows; with fewer rows than n, rows repeat."""
    if len(a) < n:
        return a[np.arange(n) * len(a) // n]
    cut = np.arange(n) * len(a) // n
    return np.add.reduceat(a, cut, axis=0) / np.diff(cut, append=len(a))[:, None]


def cosine_hash(samples: np.ndarray, step: int = SAMPLES) -> str:
    """64 bits in hex: which low-frequency cosine coefficients of the shrunken gray image exceed their
    median (the constant term aside)."""
    gray = samples.reshape(len(samples), -1, step).mean(axis=2, dtype=np.float64)
    small = _shrink(_shrink(gray, SIDE).T, SIDE).T
    c = (COSINES @ small @ COSINES.T).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def attach_media(df: DataFrame, level: int = 6) -> DataFrame:
    """(doc_id, n_bytes, media) of (doc_id, text): the padded UTF-8 text as a PNG."""

    @released
    def run(batches):
        for b in batches:
            texts = [(x or "").encode() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([encode(pad(x), level) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) what reading the stored bytes back gives."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    @released
    def run(batches):
        for b in batches:
            out = []
            for png in b.column("media").to_pylist():
                samples = decode(png)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return df.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(attach_media(keyed_text(documents(spark, sf_dir))))
