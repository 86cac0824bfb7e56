"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Pairs of adjacent symbols wait in an agenda ordered by score, then place; the best is merged and
its neighbours join the agenda (a heap; in a part of at most SHORT characters the pairs' costs in their order, of which the
least is taken). No piece of the vocabulary has the space mark after another
character, so no merge crosses into a space mark: a text is cut before each run of marks and every
cut part is encoded by itself and kept. Parts not met before are checked against the sentencepiece
library, Arrow batch by Arrow batch; a difference raises.

Defined results: a null text is empty and has no ids; a text of any length is whole; other
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from itertools import filterfalse, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import documents, keyed_text, released, tokenizer_path

MARK = "▁"
#: Parts kept by a Python worker; beyond it the store is emptied and fills again.
KEEP = 1_000_000
#: Longest part whose agenda is a plain list.
SHORT = 48


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(lib.get_piece_size())
        self.piece = [lib.id_to_piece(i) for i in n]
        special = {i for i in n if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.id = {self.piece[i]: i for i in n if i not in special}
        self.score = {self.piece[i]: lib.get_score(i) for i in n if i not in special}
        self.cost = {x: -s for x, s in self.score.items()}
        self.byte = {int(self.piece[i][3:5], 16): i for i in n if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.shown = [p.replace(MARK, " ") for p in self.piece]
        self.unknown = lib.unk_id()
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.id)

    def encode_part(self, text: str) -> list[int]:
        """Ids of one part, its spaces already marks."""
        known = self.id
        out: list[int] = []
        for x in self.merged(text) if len(text) <= SHORT else self.merged_by_heap(text):
            i = known.get(x)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in x.encode()]
            else:
                out.append(self.unknown)
        return out

    def merged(self, text: str) -> list[str]:
        """Symbols left when no pair of neighbours is a piece."""
        cost, none = self.cost.get, math.inf
        sym = list(text)
        agenda = [cost(a + b, none) for a, b in pairwise(text)]
        while agenda:
            least = min(agenda)
            if least == none:
                break
            i = agenda.index(least)
            del agenda[i]
            sym[i] = x = sym[i] + sym.pop(i + 1)
            if i < len(agenda):
                agenda[i] = cost(x + sym[i + 1], none)
            if i:
                agenda[i - 1] = cost(sym[i - 1] + x, none)
        return sym

    def merged_by_heap(self, text: str) -> list[str]:
        """The same for parts of any length, in n log n steps."""
        score = self.score
        sym: list[str] = list(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size:
                continue  # one of the two has been merged since
            sym[i] += sym[j]
            sym[j] = ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                s = score.get(sym[i] + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, len(sym[i]) + len(sym[k])))
            k = left[i]
            if k >= 0:
                s = score.get(sym[k] + sym[i])
                if s is not None:
                    heapq.heappush(agenda, (-s, k, i, len(sym[k]) + len(sym[i])))
        return [x for x in sym if x]

    def decode_part(self, ids: list[int]) -> str:
        """Text of the ids of a part; marks become spaces, runs of byte pieces their text."""
        if self.of_byte.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in [*ids, None]:
            b = self.of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None:
                out.append(self.shown[i])
        return "".join(out)


_end = re.compile(r"(?<=\w)[^\w\s]+\Z")
_cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def parts(text: str) -> list[str]:
    """The text's parts, each without the one mark that it starts with (the vocabulary puts a mark
    in front of the whole text)."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " ":
        return [x[1:] for x in _cut.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Encoder:
    """Encodes batches of texts; one lives in each Python worker."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        if self.v.crosses:
            raise ValueError("this vocabulary has merges across spaces; its texts can't be cut at them")
        self.ids: dict[str, str] = {}
        #: Decoded text of the parts that do not decode to themselves (those that hold marks).
        self.odd: dict[str, str] = {}

    def learn(self, missing: list[str]) -> None:
        """Encodes and decodes parts and compares with the library, in one call each. The library
        puts a mark in front itself."""
        v, ids_of = self.v, self.ids
        full = [x for x in missing if x]
        theirs = v.lib.encode(full, num_threads=1)
        texts = v.lib.decode(theirs, num_threads=1)
        stems: dict[str, list[int]] = {}

        def encoded(part: str) -> list[int]:
            if part not in stems:
                stems[part] = v.encode_part(part)
            return stems[part]

        for x, ids, text in zip(full, theirs, texts, strict=True):
            end = _end.search(x)
            if end and x[end.start() - 1 : end.start() + 1] not in v.pairs:
                own = encoded(MARK + x[: end.start()]) + encoded(end[0])  # no piece spans the two
            else:
                own = encoded(MARK + x)
            back = v.decode_part(own)
            if own != ids or back[1:] != text:
                raise AssertionError(f"the library treats {x!r} otherwise")
            ids_of[x] = ",".join(map(str, own)) + ","
            if text != x:
                self.odd[x] = text
        if len(full) < len(missing):
            ids_of[""] = "".join(f"{i}," for i in v.encode_part(MARK))

    def batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids, each followed by a comma; decoded text) of each text."""
        cut = [parts(x) for x in texts]
        if len(self.ids) > KEEP:
            self.ids.clear()
            self.odd.clear()
        missing: set[str] = set()
        for p in cut:
            missing.update(filterfalse(self.ids.__contains__, p))
        if missing:
            self.learn(list(missing))
        ids, odd = self.ids.__getitem__, self.odd
        return [("".join(map(ids, p)), " ".join([odd.get(x, x) for x in p] if odd else p)) for p in cut]


_encoders: dict[str, Encoder] = {}


def encode(df: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with keep_ids also ids and decoded."""

    @released
    def run(batches):
        e = _encoders.get(path)
        if e is None:
            e = _encoders[path] = Encoder(path)
        for b in batches:
            for at in range(0, len(b), 500):
                c = b.slice(at, 500)
                done = e.batch([x or "" for x in c.column("text").to_pylist()])
                columns = [
                    c.column("doc_id"),
                    pa.array([i.count(",") for i, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(i[:-1].encode()).hexdigest() for i, _ in done], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in done], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([[int(k) for k in i[:-1].split(",") if k] for i, _ in done], pa.list_(pa.int32())), pa.array([t for _, t in done], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return df.select("doc_id", "text").mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(keyed_text(documents(spark, sf_dir)), tokenizer_path("piece_bpe_32k.model"))
