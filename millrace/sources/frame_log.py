"""Frame logs as a data source: `spark.read.format("frame_log")`, `readStream` and `write`.

A log is a folder of files `<hour>-<first sequence>.frames.gz`. A file is a row of gzip members of BLOCK frames each (together
an ordinary gzip file) and has an index beside it, `.idx`, a line a member: offset, bytes, first sequence, frames. A reader's
partition is a range of offsets, so no task holds a whole file; a file without an index is read from front to back.

Writing: each task writes files of its rows under a name of its own, one an hour (rotation); the commit checks that sequences
follow on within and after what is there, and then gives the files their names, in order: a reader meanwhile finds a whole
beginning of the write. A task that is repeated after a failure leaves nothing in the log. An abort deletes what tasks wrote. Paths may be in
any store that pyarrow knows. Options: blockFrames, partBytes.

Defined results: no rows write nothing; rows may come in any order of tasks, but ascend within a task; a cut-off or damaged file
is an error; repeated sequences are an error at commit.
"""

from __future__ import annotations

import gzip
import io
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sequence, wall and monotonic nanoseconds, direction (0 in), connection, reserved (0), size; big-endian.
HEAD = ">QQQBBHI"
HEAD_BYTES = struct.calcsize(HEAD)
SCHEMA = "sequence long, wall_ns long, monotonic_ns long, direction string, connection int, raw binary"
HOUR_NS = 3_600_000_000_000
#: Frames of a gzip member, and bytes of a read partition.
BLOCK, PART_BYTES = 512, 32 << 20


class FrameLogError(ValueError):
    """A log is damaged, or rows do not follow on."""


def frames_of(read) -> Iterator[tuple]:
    """Rows of a stream of frames; read: n bytes, fewer at the end."""
    while head := read(HEAD_BYTES):
        if len(head) < HEAD_BYTES:
            raise FrameLogError("the frame log is cut off")
        seq, wall, mono, direction, connection, reserved, size = struct.unpack(HEAD, head)
        raw = read(size)
        if reserved or len(raw) < size:
            raise FrameLogError("the frame log is cut off or damaged")
        yield seq, wall, mono, "in" if direction == 0 else "out", connection, raw


@dataclass
class Range(InputPartition):
    """Bytes of a file: a run of whole gzip members, or all of it."""

    path: str
    start: int = 0
    size: int | None = None


class Committed(WriterCommitMessage):
    def __init__(self, files: list[tuple]):
        self.files = files  # (temporary path, hour, first sequence, last sequence)


class Log:
    """A folder of a store."""

    def __init__(self, uri: str, part_bytes: int = PART_BYTES):
        self.part_bytes = part_bytes
        self.store, self.folder = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)

    def files(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".frames.gz") and not f.base_name.startswith("_"))

    def index(self, path: str) -> list[tuple[int, int, int, int]] | None:
        at = f"{path}.idx"
        if self.store.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with self.store.open_input_stream(at) as f:
            return [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]

    def ranges(self, path: str) -> list[Range]:
        members = self.index(path)
        if members is None:
            return [Range(path)]
        out: list[Range] = []
        for offset, size, *_ in members:
            if out and out[-1].size + size <= self.part_bytes:
                out[-1].size += size
            else:
                out.append(Range(path, offset, size))
        return out

    def rows(self, part: Range) -> Iterator[tuple]:
        with self.store.open_input_file(part.path) as f:
            plain = f.read(2) != b"\x1f\x8b"
            f.seek(part.start)
            if plain:
                yield from frames_of(f.read)
            else:
                raw = io.BytesIO(f.read(part.size)) if part.size is not None else f
                with gzip.GzipFile(fileobj=raw) as g:
                    try:
                        yield from frames_of(g.read)
                    except EOFError as e:
                        raise FrameLogError("the frame log is cut off") from e

    def last(self) -> int | None:
        """The last sequence there is."""
        files = self.files()
        if not files:
            return None
        members = self.index(files[-1])
        if members:
            return members[-1][2] + members[-1][3] - 1
        return max((r[0] for r in self.rows(Range(files[-1]))), default=None)


class Reader(DataSourceReader):
    def __init__(self, uri: str, part_bytes: int):
        self.uri, self.part_bytes = uri, part_bytes

    def partitions(self):
        log = Log(self.uri, self.part_bytes)
        return [r for f in log.files() for r in log.ranges(f)] or [Range("")]

    def read(self, partition):
        if partition.path:
            yield from Log(self.uri).rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets count the log's files in order of their names; files never change once they have their name."""

    def __init__(self, uri: str, part_bytes: int):
        self.uri, self.part_bytes = uri, part_bytes

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        return {"files": len(Log(self.uri).files())}

    def partitions(self, start, end):
        log = Log(self.uri, self.part_bytes)
        return [r for f in log.files()[start["files"] : end["files"]] for r in log.ranges(f)]

    def read(self, partition):
        yield from Log(self.uri).rows(partition)

    def commit(self, end):
        pass


class Writer(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool, block: int):
        self.uri, self.overwrite, self.block_frames = uri, overwrite, block

    def write(self, iterator):
        log, files, hour, block, out, index, offset, last = Log(self.uri), [], None, [], None, [], 0, None
        log.store.create_dir(log.folder, recursive=True)

        def flush():
            nonlocal offset
            if block:
                raw = gzip.compress(b"".join(struct.pack(HEAD, s, w, m, 0 if d == "in" else 1, c, 0, len(x)) + x for s, w, m, d, c, x in block), 1, mtime=0)
                out.write(raw)
                index.append((offset, len(raw), block[0][0], len(block)))
                offset += len(raw)
                block.clear()

        def close():
            if out:
                flush()
                out.close()
                with log.store.open_output_stream(f"{files[-1][0]}.idx") as f:
                    f.write("".join(" ".join(map(str, line)) + "\n" for line in index).encode())

        for r in iterator:
            row = (r["sequence"], r["wall_ns"], r["monotonic_ns"], r["direction"], r["connection"], bytes(r["raw"]))
            if last is not None and row[0] != last + 1:
                raise FrameLogError(f"sequence {row[0]} after {last}")
            if row[1] // HOUR_NS != hour:
                close()
                hour, index, offset = row[1] // HOUR_NS, [], 0
                files.append([f"{log.folder}/_{uuid.uuid4().hex}.tmp", hour, row[0], row[0]])
                out = log.store.open_output_stream(files[-1][0])
            block.append(row)
            last = files[-1][3] = row[0]
            if len(block) == self.block_frames:
                flush()
        close()
        return Committed([tuple(f) for f in files])

    def commit(self, messages):
        log = Log(self.uri)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[2])
        old = log.files() if self.overwrite else []
        last = None if self.overwrite else log.last()
        for _, _, first, end in files:
            if last is not None and first != last + 1:
                self.abort(messages)
                raise FrameLogError(f"sequence {first} after {last}")
            last = end
        for path in old:
            for p in (path, f"{path}.idx"):
                if log.store.get_file_info(p).type != fs.FileType.NotFound:
                    log.store.delete_file(p)
        for path, hour, first, _ in files:
            to = f"{log.folder}/{hour:08d}-{first:020d}.frames.gz"
            log.store.move(f"{path}.idx", f"{to}.idx")  # the index first: a file that has its name has one
            log.store.move(path, to)

    def abort(self, messages):
        log = Log(self.uri)
        for path in [f[0] for m in messages if m for f in m.files]:
            for p in (path, f"{path}.idx"):
                if log.store.get_file_info(p).type != fs.FileType.NotFound:
                    log.store.delete_file(p)


class FrameLog(DataSource):
    @classmethod
    def name(cls):
        return "frame_log"

    def schema(self):
        return SCHEMA

    def _part(self) -> int:
        return int(self.options.get("partBytes", PART_BYTES))

    def reader(self, schema):
        return Reader(self.options["path"], self._part())

    def streamReader(self, schema):
        return StreamReader(self.options["path"], self._part())

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], overwrite, int(self.options.get("blockFrames", BLOCK)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameLog)
