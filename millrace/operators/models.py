"""Probability models: smoothed lookup, transition matrix, ridge logistic regression."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import scalars as S
from ..sources.scratch import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ModelFitError(ValueError):
    """The training rows cannot carry a model."""


def lookup_model(train: DataFrame, edges: list[float], terminal_alpha: float = 20.0, transition_alpha: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(by, bin, probability_up, support, persistence) over all bins, from valid labelled rows: a model of each key, such as a fold.

    p = (wins + alpha * prior) / (support + alpha). Rows are summed to pairs of bins once and those kept, so the rows are read once; all
    further steps work on bins squared of a few keys. A key without such rows has no model."""
    by = by or []
    n = len(edges) - 1
    spark = train.sparkSession
    rows = train.where(F.col("snapshot_valid") & F.col("outcome_up").between(0, 1))
    pairs = kept(rows.groupBy(*by, S.state_bin(F.col("previous_mid_up"), edges).alias("prev_bin"), S.state_bin(F.col("mid_up"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome_up").alias("wins")))
    bins = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    all_rows = pairs.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("wins").alias("all_wins"))
    per = pairs.groupBy(*by, "bin").agg(F.sum("n").alias("support"), F.sum("wins").alias("wins"))
    stay = pairs.where("prev_bin = bin").select(*by, "bin", F.col("n").alias("stay"))
    leave = pairs.groupBy(*by, F.col("prev_bin").alias("bin")).agg(F.sum("n").alias("leave"))
    d, keys = bins.join(F.broadcast(all_rows)), [*by, "bin"]  # a row a key
    for part in (per, stay, leave):
        d = d.join(F.broadcast(part), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, b = terminal_alpha, transition_alpha
    prior = F.col("all_wins") / F.col("all_n")
    return d.select(
        *keys, ((zero("wins") + a * prior) / (zero("support") + a)).alias("probability_up"), zero("support").cast("long").alias("support"), ((zero("stay") + b) / (zero("leave") + b * n)).alias("persistence")
    )


def transitions(rows: DataFrame, prev: Column, now: Column, n: int, alpha: float = 1.0) -> DataFrame:
    """Row-normalised (prev_bin, bin, p) on all n x n cells; a row without counts is uniform."""
    spark = rows.sparkSession
    counts = rows.groupBy(prev.alias("prev_bin"), now.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("prev_bin"), (F.col("id") % n).cast("int").alias("bin"))
    c = cells.join(F.broadcast(counts), ["prev_bin", "bin"], "left").withColumn("smoothed", F.coalesce("n", F.lit(0)) + alpha)
    w = Window.partitionBy("prev_bin")
    return c.select("prev_bin", "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("smoothed") / F.sum("smoothed").over(w)).alias("p"))


def literal_one_step(matrix: DataFrame, edges: list[float]) -> DataFrame:
    """(bin, expected_mid): the matrix applied to the bins' centres."""
    k = F.col("bin")
    at = F.array(*map(F.lit, edges))
    centre = (F.element_at(at, k + 1) + F.element_at(at, k + 2)) / 2
    return matrix.groupBy(F.col("prev_bin").alias("bin")).agg(F.sum(F.col("p") * centre).alias("expected_mid"))


def fit_logistic(rows: DataFrame, features: list[str], outcome: str, weight: str | None = None, group: str | None = None, ridge: float = 1e-3, iterations: int = 30, monotone: bool = True, require: bool = True) -> dict:
    """Weighted ridge logistic regression of each group by Newton steps: {group: (mean, scale, coefficients)}; see `fit_logistics`."""
    return fit_logistics(rows, {"": (features, weight)}, outcome, group, ridge, iterations, monotone, require)[""]


def fit_logistics(rows: DataFrame, variants: dict[str, tuple[list[str], str | None]], outcome: str, group: str | None = None, ridge: float = 1e-3, iterations: int = 30, monotone: bool = True, require: bool = True) -> dict[str, dict]:
    """Weighted ridge logistic regressions of several variants (features, weight) and all groups at once, by Newton steps:
    {variant: {group: (mean, scale, coefficients)}}.

    Each step is one pass over the rows for all of them: batches add up gradients and Hessians, and only
    the sums of all rows, (d + 1) * (d + 2) a variant and group, reach the driver. Rows count for a variant if all its features, the outcome (0 to
    1) and the weight (positive) are finite; a group needs more than d + 2 of
    them, or is an error (require), or has no model. Weights are
    divided by their mean, features centred and divided by their deviation (variance 1e-12 at least). The
    intercept is not penalised and starts at the prior's logit; coefficient 1 is kept from falling below 0."""
    names = list(dict.fromkeys(f for features, _ in variants.values() for f in features))
    weights = list(dict.fromkeys(w for _, w in variants.values()))
    g = F.col(group) if group else F.lit(0)
    own = [F.col(outcome).cast("double").alias("y")]
    own += [(F.col(w) if w else F.lit(1.0)).cast("double").alias(f"w{k}") for k, w in enumerate(weights)]
    own += [F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(names)]
    stored = rows.select(g.alias("g"), *own).persist(StorageLevel.MEMORY_AND_DISK)
    forms = [(f"w{weights.index(w)}", [f"x{names.index(f)}" for f in features]) for features, w in variants.values()]
    try:
        fitted = _newton(stored, forms, ridge, iterations, monotone, require)
    finally:
        stored.unpersist()
    return {name: {k: fit for (v, k), fit in fitted.items() if v == n} for n, name in enumerate(variants)}


def _summed(rows: DataFrame, forms: list[tuple[str, list[str]]], sums) -> dict:
    """{(variant, group): sums over its valid rows}, of one pass. sums takes the variant, the group, outcomes, weights and features of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = {}, None
        for b in batches:
            g = b.column(b.schema.get_field_index("g"))
            kind, codes = g.type, g.dictionary_encode("encode")
            keys, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            of = {n: b.column(k).to_numpy(zero_copy_only=False).astype(float) for k, n in enumerate(b.schema.names) if n != "g"}
            y = of["y"]
            for v, (weight, features) in enumerate(forms):
                w, x = of[weight], np.stack([np.ones(len(y)), *(of[f] for f in features)], 1)
                valid = np.isfinite(x).all(1) & (y >= 0) & (y <= 1) & (w > 0) & np.isfinite(w)
                for k, key in enumerate(keys):
                    own = valid & (code == k)
                    part = sums(v, key, y[own], w[own], x[own])
                    if part is not None:
                        total[v, key] = total[v, key] + part if (v, key) in total else part
        if total:
            long = [(v, key, i, float(n)) for (v, key), part in total.items() for i, n in enumerate(part)]
            columns = list(zip(*long, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())], ["v", "g", "i", "n"])

    parts = rows.mapInArrow(run, f"v int, g {rows.schema['g'].dataType.simpleString()}, i int, n double")
    out = {}
    for r in parts.groupBy("v", "g", "i").agg(F.sum("n").alias("n")).collect():  # the sums of each variant and group
        out.setdefault((r["v"], r["g"]), {})[r["i"]] = r["n"]
    return {k: np.array([n for _, n in sorted(s.items())]) for k, s in out.items()}


def _newton(rows: DataFrame, forms: list[tuple[str, list[str]]], ridge: float, iterations: int, monotone: bool, require: bool) -> dict:
    first = _summed(rows, forms, lambda v, k, y, w, x: np.array([len(y), w.sum(), w @ y, *(w @ x[:, 1:])]))
    few = [k for k, s in first.items() if s[0] <= len(forms[k[0]][1]) + 2]
    if require and (few or not first):
        raise ModelFitError(f"too few valid rows: {sorted({str(g) for _, g in few})}")
    first = {k: s for k, s in first.items() if k not in few}
    if not first:
        return {}
    mean = {k: s[3:] / s[1] for k, s in first.items()}

    def squares(v, k, y, w, x):
        return np.append(w @ (x[:, 1:] - mean[v, k]) ** 2, 0.0) if (v, k) in mean and len(y) else None

    spread = _summed(rows, forms, squares)
    state = {}
    for k, s in first.items():
        scale = np.sqrt(np.maximum(spread[k][:-1] / s[1], 1e-12))
        prior = min(max(s[2] / s[1], 1e-6), 1 - 1e-6)
        beta = np.zeros(len(scale) + 1)
        beta[0] = np.log(prior / (1 - prior))
        state[k] = (mean[k], scale, beta, s[0] / s[1])
    done = set()
    for _ in range(iterations):
        now = {k: s for k, s in state.items() if k not in done}
        if not now:
            break

        def derivatives(v, k, y, w, x, now=now):
            if (v, k) not in now or not len(y):
                return None
            centre, scale, beta, unit = now[v, k]
            z = np.concatenate([x[:, :1], (x[:, 1:] - centre) / scale], 1)
            t = z @ beta
            p = np.exp(np.minimum(t, 0)) / (1 + np.exp(-np.abs(t)))
            w = w * unit
            return np.append((w * (y - p)) @ z, ((w * p * (1 - p)) * z.T @ z).ravel())

        for k, s in _summed(rows, forms, derivatives).items():
            centre, scale, beta, unit = state[k]
            d = len(scale)
            grad, hess = s[: d + 1], s[d + 1 :].reshape(d + 1, d + 1)
            penalty = np.full(d + 1, ridge)
            penalty[0] = 0.0
            step = np.linalg.solve(hess + np.diag(penalty), grad - penalty * beta)
            new = beta + step
            if monotone and d:
                new[1] = max(new[1], 0.0)
            # Where coefficient 1 is held at 0 the step itself never vanishes, but what it leads to stays.
            if min(np.abs(step).max(), np.abs(new - beta).max()) < 1e-10:
                done.add(k)
            state[k] = (centre, scale, new, unit)
    if not all(np.isfinite(s[2]).all() for s in state.values()):
        raise ModelFitError("coefficients are not finite")
    return {k: s[:3] for k, s in state.items()}


def logistic_probability(features: list[str], fitted: tuple, low: float = 0.0, high: float = 1.0) -> Column:
    """The probability as one expression over the features' columns."""
    mean, scale, beta = fitted
    z = sum((F.lit(float(beta[k + 1])) * (F.col(f) - float(mean[k])) / float(scale[k]) for k, f in enumerate(features)), F.lit(float(beta[0])))
    return F.least(F.greatest(S.sigmoid(z), F.lit(low)), F.lit(high))


def predict_logistic(df: DataFrame, features: list[str], fitted: tuple, low: float = 0.0, high: float = 1.0, name: str = "probability_up") -> DataFrame:
    return df.withColumn(name, logistic_probability(features, fitted, low, high))


def price_features(df: DataFrame) -> DataFrame:
    """Features that a snapshot alone gives."""
    return df.withColumns({"logit_mid_up": S.logit(F.col("mid_up")), "mid_change": F.col("mid_up") - F.col("previous_mid_up"), "spread_up": F.col("ask_up") - F.col("bid_up"), "spread_down": F.col("ask_down") - F.col("bid_down"), "dislocation": F.col("mid_up") + F.col("mid_down") - 1})
