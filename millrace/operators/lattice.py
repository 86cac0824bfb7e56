"""Grids of any number of threshold axes: sums and drawdown of every cell.

A market passes a cell if it clears the cell's threshold on every axis, so its cells are a box of the lattice. Sums
of cells are running sums along the axes (markets + axes x cells). A drawdown depends on order: trades are dealt in order to equal
pieces, and each piece is walked over classes of cells that the same trades pass, which leaves four numbers a cell and bucket of
time (sum, highest and lowest running sum, drawdown); those of later buckets and pieces are merged to them in order.

Defined results: a missing value clears no threshold; a cell without trades has zeros; trades at one time are in order of
condition_id; no trades give zeros for the keys (`by`) that there are.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranges of trades in order that are walked apart.
PIECES = 24
#: Places times cells that are compared at once.
LARGEST = 200_000_000
TWICE = "the order of trades is not strict: a market stands twice at one time"


@dataclass(frozen=True)
class Axis:
    """Ascending thresholds of a column; most: values up to the threshold pass, else those from it on."""

    name: str
    column: str
    values: tuple[float, ...]
    most: bool = False

    def place(self) -> Column:
        """The last index that a row clears, for `most` the first; -1 or the length where it clears none."""
        v = F.col(self.column)
        if self.most:
            return F.when(v.isNull() | F.isnan(v), len(self.values)).otherwise(S.passed(v, self.values))
        return F.when(v.isNull() | F.isnan(v), -1).otherwise(S.passed(v, self.values, at=True) - 1)


@dataclass(frozen=True)
class Lattice:
    axes: tuple[Axis, ...]
    #: Names of two axes of which the first's threshold must be below the second's.
    below: tuple[str, str] | None = None

    def indices(self) -> np.ndarray:
        """Rows of axis indices, one a cell, in order of cell_id."""
        i = np.stack(np.meshgrid(*(np.arange(len(a.values)) for a in self.axes), indexing="ij"), -1).reshape(-1, len(self.axes))
        if self.below:
            names = [a.name for a in self.axes]
            lo, hi = (names.index(n) for n in self.below)
            i = i[np.array(self.axes[lo].values)[i[:, lo]] < np.array(self.axes[hi].values)[i[:, hi]]]
        return i

    def numbers(self) -> np.ndarray:
        return np.ravel_multi_index(self.indices().T, [len(a.values) for a in self.axes])

    def at(self) -> list[str]:
        return [f"at_{a.name}" for a in self.axes]

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell_id, at_<axis>, <axis>) by arithmetic on the number of the cell."""
        size = math.prod(len(a.values) for a in self.axes)
        d, rest = spark.range(size).withColumnRenamed("id", "cell_id"), size
        for a in self.axes:
            rest //= len(a.values)
            index = (F.floor(F.col("cell_id") / rest) % len(a.values)).cast("int")
            d = d.withColumns({f"at_{a.name}": index, a.name: F.element_at(F.array(*(F.lit(float(v)) for v in a.values)), index + 1)})
        return d.where(F.col(self.below[0]) < F.col(self.below[1])) if self.below else d

    def placed(self, trades: DataFrame) -> DataFrame:
        if set(self.at()) <= set(trades.columns):
            return trades
        d = trades.withColumns({f"at_{a.name}": a.place() for a in self.axes})
        for a in self.axes:
            d = d.where(F.col(f"at_{a.name}") < len(a.values) if a.most else F.col(f"at_{a.name}") >= 0)
        return d


def sums(trades: DataFrame, keys: DataFrame, lattice: Lattice, values: dict[str, Column]) -> DataFrame:
    """(keys, cell_id, thresholds, fills, values): sums over each cell's trades. keys: a small table, such as folds."""
    by, at = keys.columns, lattice.at()
    points = lattice.placed(trades).groupBy(*by, *at).agg(F.count(F.lit(1)).alias("fills"), *(F.sum(c).alias(n) for n, c in values.items()))
    whole = Lattice(lattice.axes).cells(trades.sparkSession).select(*at)
    d = whole.crossJoin(F.broadcast(keys)).join(points, [*by, *at], "left").na.fill(0, ["fills", *values])  # a configured lattice
    for a in lattice.axes:
        if len(a.values) == 1:
            continue
        here = f"at_{a.name}"
        w = Window.partitionBy(*by, *(x for x in at if x != here)).orderBy(F.col(here) if a.most else F.desc(here)).rowsBetween(Window.unboundedPreceding, 0)
        d = d.select(*by, *at, *(F.sum(c).over(w).alias(c) for c in ["fills", *values]))
    return d.join(F.broadcast(lattice.cells(trades.sparkSession)), at).drop(*at)


def _classes(cells: np.ndarray, places: np.ndarray, most: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Cells that the same places pass are one class. places: distinct rows. Returns which places pass each class (places x classes), and each cell's class."""
    near = np.zeros(len(cells), np.int64)
    for k, m in enumerate(most):
        # Thresholds between the same two of the places that occur are alike.
        occurring = np.unique(places[:, k])
        near = near * (len(occurring) + 1) + np.searchsorted(occurring, cells[:, k], "right" if m else "left")
    _, first, of = np.unique(near, return_index=True, return_inverse=True)
    inside = np.ones((len(places), len(first)), bool)
    for k, m in enumerate(most):
        c, at = cells[first, k][None, :], places[:, k][:, None]
        inside &= c >= at if m else c <= at
    bits = np.ascontiguousarray(np.packbits(inside, axis=0).T)
    _, one, same = np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return inside[:, one], same.ravel()[of.ravel()]


def _stretch(cells: np.ndarray, most: list[bool], at: np.ndarray, pnl: np.ndarray, state: np.ndarray) -> None:
    """Adds trades in order to the cells' state (rows: sum, highest, lowest, fall, seen)."""
    places, kind = np.unique(at, axis=0, return_inverse=True)
    if len(places) * len(cells) > LARGEST and len(at) > 1:
        half = len(at) // 2
        _stretch(cells, most, at[:half], pnl[:half], state)
        _stretch(cells, most, at[half:], pnl[half:], state)
        return
    passing, of = _classes(cells, places, most)
    kind, own = kind.ravel(), np.zeros((5, passing.shape[1]))
    for c in np.flatnonzero(passing.any(0)):
        cum = np.cumsum(pnl[passing[:, c][kind]])
        peak = np.maximum(np.maximum.accumulate(cum), 0.0)
        own[:, c] = cum[-1], peak[-1], min(cum.min(), 0.0), (peak - cum).max(), 1.0
    s, hi, lo, fall, seen = state
    add, high, low, down, some = own[:, of]
    fall[:] = np.maximum(np.maximum(fall, down), hi - s - low)
    hi[:] = np.maximum(hi, s + high)
    lo[:] = np.minimum(lo, s + low)
    s += add
    seen[:] = np.maximum(seen, some)


def _walk(lattice: Lattice, by: list[str]):
    cells, numbers = lattice.indices().astype(np.int16), lattice.numbers()
    # Tasks get plain values: the modules that Lattice needs may not be where they run.
    most, keys, places = [a.most for a in lattice.axes], [*by, "bucket"], lattice.at()

    def part(first: list[pa.Scalar], piece: int, state: np.ndarray) -> pa.RecordBatch:
        i = np.flatnonzero(state[4])
        sums = pa.StructArray.from_arrays([pa.array(x[i]) for x in state[:4]], ["sum", "hi", "lo", "fall"])
        return pa.RecordBatch.from_arrays([*(pa.repeat(v, len(i)) for v in first), pa.repeat(pa.scalar(piece, pa.int32()), len(i)), pa.array(numbers[i]), sums], [*keys, "piece", "cell_id", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, now, last, state = TaskContext.get().partitionId(), None, None, np.zeros((5, len(cells)))
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            codes = [t.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in keys]
            ids, starts = t.column("condition_id").to_numpy(), t.column("market_start_s").to_numpy()
            new = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], 0)) + 1
            if ((np.diff(ids) == 0) & (np.diff(starts) == 0) & ~np.isin(np.arange(1, len(ids)), new)).any():
                raise ValueError(TWICE)
            pnl, at = t.column("net_pnl").to_numpy(), np.stack([t.column(c).to_numpy() for c in places], 1)
            for i, j in itertools.pairwise([0, *new.tolist(), len(ids)]):
                key = [t.column(c)[i] for c in keys]
                if now is not None and key != now:
                    yield part(now, piece, state)
                    state[:] = 0.0
                elif now is not None and last == (ids[i], starts[i]):
                    raise ValueError(TWICE)
                now, last = key, (ids[j - 1], starts[j - 1])
                _stretch(cells, most, at[i:j], pnl[i:j], state)
        if now is not None:
            yield part(now, piece, state)

    return run


def drawdowns(trades: DataFrame, by: list[str], lattice: Lattice, bucket_s: int) -> DataFrame:
    """(by, cell_id, replay_pnl, max_drawdown) of the cells that have trades: the last running sum and the largest fall.
    trades: condition_id, market_start_s, net_pnl and the axes' columns; two of one market and time are an error."""
    p = lattice.placed(trades).select(*by, F.floor(F.col("market_start_s") / bucket_s).cast("long").alias("bucket"), "market_start_s", "condition_id", "net_pnl", *lattice.at())
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    part = "struct<sum:double,hi:double,lo:double,fall:double>"
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*by, "bucket"]), "piece int", "cell_id long", f"part {part}"])
    walk = _walk(lattice, by)
    order = [*by, "market_start_s", "condition_id"]
    walked = p.repartitionByRange(PIECES, *order).sortWithinPartitions(*order).mapInArrow(lambda b: walk(b), schema)
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("sum", "hi", "lo", "fall")))

    def merge(a: Column, b: Column) -> Column:
        x = b["part"]
        return F.struct((a["sum"] + x["sum"]).alias("sum"), F.greatest(a["hi"], a["sum"] + x["hi"]).alias("hi"), F.least(a["lo"], a["sum"] + x["lo"]).alias("lo"), F.greatest(a["fall"], x["fall"], a["hi"] - a["sum"] - x["lo"]).alias("fall"))

    # As many parts a cell as there are buckets in the period and pieces, at most.
    parts = walked.groupBy(*by, "cell_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "piece", "part"))).alias("parts"))
    walked = parts.select(*by, "cell_id", F.aggregate("parts", zero, merge).alias("w"))
    return walked.select(*by, "cell_id", F.col("w.sum").alias("replay_pnl"), F.col("w.fall").alias("max_drawdown"))


def metrics(trades: DataFrame, keys: DataFrame, lattice: Lattice, values: dict[str, Column], bucket_s: int) -> DataFrame:
    """Sums and drawdown of every cell, and the profit that its replay in order gives (replay_pnl)."""
    trades = kept(lattice.placed(trades))
    fall = drawdowns(trades, keys.columns, lattice, bucket_s)
    return sums(trades, keys, lattice, values).join(fall, [*keys.columns, "cell_id"], "left").na.fill(0.0, ["replay_pnl", "max_drawdown"])
