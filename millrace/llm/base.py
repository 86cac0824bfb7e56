"""What the text operators share: reading, shipping, row ids, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H

ROW = "__row"
#: Bits of a filter: 4 MB at any size of the input.
FILTER_BITS = 1 << 25
#: Removes the shuffle files of a finished command.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose import path need not be the driver's; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    path = Path(tempfile.mkdtemp()) / f"millrace_{mark}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._millrace_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a local one is set for this session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="millrace-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and
    a lost executor costs a reread only. Shuffle files of the write go once it is done. by: a column
    that has a folder for each value. The table stays until `dropped`, or until the folder is emptied (see README)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def dropped(table: DataFrame, part: str = "") -> None:
    """Deletes a table of `stored`, or a folder of it, whose last reader is done."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{table._millrace_path}/{part}".rstrip("/"))
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_row(df: DataFrame) -> DataFrame:
    """Adds a long per row, unique also where doc_id is null or repeats. It follows from the
    splits of the files read, so every pass over the same table gives the same numbers."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def keyed_text(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row id, doc_id, text) with null texts as empty ones; other columns are dropped, so none can clash."""
    return with_row(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).select(ROW, "doc_id", "text")


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: it sets the number of groups, so that a group keeps its size as the input grows."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def groups_for(total: int, each: int, least: int = 8) -> int:
    return max(least, -(-total // each))


def _tidy() -> None:
    """Gives what a Python worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own way
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """A function of Arrow batches that leaves nothing behind in its worker, or of a group's table."""

    @functools.wraps(run)
    def batches(parts):
        try:
            yield from run(parts)
        finally:
            _tidy()

    return batches


def released_group(run):
    @functools.wraps(run)
    def group(t):
        try:
            return run(t)
        finally:
            del t
            _tidy()

    return group


def slices(b: pa.RecordBatch, rows: int = 256):
    """Parts of a batch, for work on Python objects."""
    for i in range(0, len(b), rows):
        yield b.slice(i, rows)


def filter_of(rows: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A bit filter from (cell, mask) rows: at most size / 64 rows come to the driver, whatever the input."""
    t = rows.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[t.column("cell").to_numpy()] = t.column("mask").to_numpy().view(np.uint64)
    return bits


def row_filter(rows: DataFrame) -> np.ndarray:
    """The filter of a table's row ids."""

    @released
    def run(batches):
        for b in batches:
            yield H.cells(H.mix(b.column(ROW).to_numpy().view(np.uint64).copy()), FILTER_BITS)

    return filter_of(rows.select(ROW).mapInArrow(run, "cell int, mask long"))


def squeezed(docs: DataFrame, *others: str, only: np.ndarray | None = None) -> DataFrame:
    """(row id, others, text compressed): half of what a shuffle of texts would move. only: a filter of row ids; it leaves
    out most of the rows that a join would drop, and none of the others."""
    names = [ROW, *others, "z"]

    @released
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in (c for whole in batches for c in slices(whole)):
            if only is not None:
                b = b.filter(pa.array(H.passes(only, H.mix(b.column(ROW).to_numpy().view(np.uint64).copy()))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array([z.compress(x.encode()) for x in b.column("text").to_pylist()], pa.binary())], names)

    return docs.select(*names[:-1], "text").mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", z binary")


def unsqueezed(column: pa.ChunkedArray) -> pa.Array:
    """The texts of a column of `squeezed`."""
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x) if x else b"" for x in column.to_pylist()], pa.binary())


def fixed(df: DataFrame, name: str = "docs") -> DataFrame:
    """df as it is where it only reads files, whose rows keep their order and so their ids; otherwise a
    stored copy, so that a stage that is computed again cannot number rows anew."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    nodes = [re.sub(r"^[\s:+\-*()0-9]*", "", line) for line in plan.splitlines()]
    return df if all(n.startswith(("Project", "Filter", "FileScan", "LocalTableScan")) for n in nodes if n) else stored(df, name)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR overrides the installed package's."""
    at = os.environ.get("TOKENIZER_DIR")
    if at:
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)
