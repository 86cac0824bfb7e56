"""Structured Streaming over the event feed: book state, feed health, boundary matching.

A row counts at a cutoff if it was received by then; watermarks only bound how long state is kept.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.book import FOLDED, Book

STATE = "bids map<double,double>, asks map<double,double>, best_bid double, best_ask double, ready boolean, ignored long, crossed long"


def _load(state: GroupState) -> Book:
    b = Book()
    if state.exists:
        bids, asks, bid, ask, b.ready, b.ignored, b.crossed = state.get
        b.levels = {"bid": dict(bids or {}), "ask": dict(asks or {})}
        b.best = {"bid": bid, "ask": ask}
    return b


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    book = _load(state)
    rows = pd.concat(list(frames)).sort_values(["t", "event_id"])  # a micro-batch of one token
    for kind, price, size in zip(rows["kind"], rows["price"], rows["size"], strict=True):
        book.apply(kind, price, size)
    state.update((book.levels["bid"], book.levels["ask"], book.best["bid"], book.best["ask"], book.ready, book.ignored, book.crossed))
    yield pd.DataFrame([(key[0], *book.row())], columns=[c.split()[0] for c in FOLDED.split(", ")]).astype({"best_bid": float, "best_ask": float})


def books(events: DataFrame) -> DataFrame:
    """The book of each token after each micro-batch in which it had events."""
    return events.groupBy("token").applyInPandasWithState(_step, FOLDED, STATE, "update", GroupStateTimeout.NoTimeout)


def health(events: DataFrame, by: str = "kind") -> DataFrame:
    """Per connection: messages and first and last time. Gaps need order and come from the batch."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("messages"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def stale(health_rows: DataFrame, now: int, after: int) -> DataFrame:
    """Adds whether a feed has been silent for longer than `after`."""
    return health_rows.withColumn("stale", (F.lit(now) - F.col("last_t")) > after)


def batch_health(events: DataFrame, by: str = "kind") -> DataFrame:
    """Per connection: messages, largest gap between messages, last time."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("t", "event_id")
    d = events.withColumn("gap", F.col("t") - F.lag("t").over(w))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("messages"), F.max("gap").alias("largest_gap"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def sunk(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and reads the sink back: a table in the shared folder that
    holds each micro-batch's rows with its number (epoch). A batch that is repeated after a failure
    replaces its own folder, so its rows are there once."""
    spark = stream.sparkSession
    at = f"{_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(put).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    schema = StructType([*stream.schema, StructField("epoch", IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{at}/rows").parquet(f"{at}/rows") if _is_dir(spark, f"{at}/rows") else spark.createDataFrame([], schema)


def drain(stream: DataFrame, mode: str, keep: str) -> DataFrame:
    """The last row of each key of a stream that is run over all that is there."""
    rows = sunk(stream, mode)
    last = rows.groupBy(keep).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (keep, "epoch")]), "epoch").alias("r"))
    return last.select(keep, "r.*")


def _folder(spark: SparkSession) -> str:
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="millrace-stream-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The sample events as a stream of book events."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else sf_dir + "/events.parquet*")
    kind = F.when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type") == "purchase", "bid").when(F.col("event_type") == "click", "ask").when(F.col("event_type") == "view", "best_bid").otherwise("best_ask")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("token"), us.alias("t"), kind.alias("kind"), (F.get_json_object("props", "$.k").cast("long") / 100).alias("price"), (F.floor("value") % 5).cast("long").alias("size"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def subscription_window(markets: DataFrame, now: int, before: int = 30, after: int = 60) -> DataFrame:
    """Markets to listen to: open between now - before and now + after."""
    return markets.where((F.col("market_start_s") <= now + after) & (F.col("market_end_s") >= now - before))


def due_resolutions(markets: DataFrame, now: int, wait: int = 60) -> DataFrame:
    """Unresolved markets that ended at least `wait` seconds ago."""
    return markets.where(F.col("outcome_up").isNull() & (F.col("market_end_s") + wait <= now))


def subscription_delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys to add and to drop."""
    add = new.select(key).exceptAll(old.select(key)).withColumn("action", F.lit("subscribe"))
    return add.unionByName(old.select(key).exceptAll(new.select(key)).withColumn("action", F.lit("unsubscribe")))


def now_s() -> int:
    return int(time.time())
