"""Market records from raw event documents: typed rows, and beside them each document that gives none, with the reason.

Documents are JSON texts, an event each, parsed once into a VARIANT; a field may be missing or of another kind, and lists may come as
JSON text within the JSON. No document stops a run: a broken one is a reject, one that is out of scope (outside the period, not
settled yet) is left out under its own reason. The first rule that a document breaks is its reason.

Defined results: null and empty texts are rejects; equal condition ids with equal records are one row, with unlike ones rejects
(`conflicts`); other columns of the input are kept beside the rejects only; no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["event_id", "market_id", "slug", "condition_id", "token_up", "token_down", "market_start_ms", "market_end_ms", "outcome_up", "fee_rate", "fee_exponent", "fees_enabled", "resolution_source", "rules"]
#: Reasons that are no faults.
OUT_OF_SCOPE = ("outside the period", "not settled")


@dataclass(frozen=True)
class Scope:
    period_start_ms: int
    period_end_ms: int
    duration_s: int
    #: Whether an outcome is needed: a settled universe, or markets as they are discovered.
    settled: bool = True


def _text(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "string")


def _first(*columns: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def _list(v: str, path: str) -> Column:
    """A list of texts, or of a JSON text that holds one."""
    return F.coalesce(F.try_variant_get(F.col(v), path, "array<string>"), F.from_json(_text(v, path), "array<string>"))


def _millis(c: Column) -> Column:
    """Milliseconds of a time with a zone; NULL without one."""
    zoned = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.unix_millis(F.try_to_timestamp(c)))


def parsed(documents: DataFrame, text: str, scope: Scope) -> DataFrame:
    """Adds reason (NULL for a good record) and the fields of each document."""
    # An explode of one element: the parse stands behind it, and isn't repeated for each field.
    d = documents.withColumn("__v", F.explode(F.array(F.try_parse_json(F.col(text)))))
    market = "$.markets[0]"
    end, start = _millis(_text("__v", "$.endDate")), _text("__v", "$.startTime")
    d = d.withColumns({
        "__end_text": _text("__v", "$.endDate"), "__start_text": start, "market_end_ms": end, "market_start_ms": F.when(F.coalesce(start, F.lit("")) != "", _millis(start)).otherwise(end - scope.duration_s * 1000),
        "__one": _text("__v", market).isNotNull() & _text("__v", "$.markets[1]").isNull(), "__outcomes": _list("__v", f"{market}.outcomes"), "__tokens": _list("__v", f"{market}.clobTokenIds"), "__prices": F.transform(_list("__v", f"{market}.outcomePrices"), lambda x: x.try_cast("double")),
        "fees_enabled": F.coalesce(F.try_variant_get(F.col("__v"), f"{market}.feesEnabled", "boolean"), F.lit(False)), "__rate": F.try_variant_get(F.col("__v"), f"{market}.feeSchedule.rate", "double"),
        "__exponent": F.coalesce(F.try_variant_get(F.col("__v"), f"{market}.feeSchedule.exponent", "double"), F.lit(1.0)), "__taker": F.coalesce(F.try_variant_get(F.col("__v"), f"{market}.feeSchedule.takerOnly", "boolean"), F.lit(False)),
        "condition_id": F.lower(_first(_text("__v", f"{market}.conditionId"))), "event_id": _first(_text("__v", "$.id")), "market_id": _first(_text("__v", f"{market}.id")), "slug": _first(_text("__v", f"{market}.slug"), _text("__v", "$.slug")),
        "resolution_source": _first(_text("__v", f"{market}.resolutionSource"), _text("__v", "$.resolutionSource")), "rules": _first(_text("__v", f"{market}.description"), _text("__v", "$.description")),
    })
    fields = [c for c in d.columns if c not in documents.columns and c != "__v"]
    d = d.withColumn("__f", F.explode(F.array(F.struct(*fields, F.col("__v").isNull().alias("__bad"))))).select(*documents.columns, "__f.*")
    pair = lambda a, b: F.coalesce((F.col("__prices")[0] == a) & (F.col("__prices")[1] == b) & (F.size("__prices") == 2), F.lit(False))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("__bad"), "not JSON")
        .when(F.col("market_end_ms").isNull(), "end time is missing or has no zone")
        .when(F.col("market_start_ms").isNull(), "start time has no zone")
        .when(no((F.col("market_start_ms") >= scope.period_start_ms) & (F.col("market_start_ms") < scope.period_end_ms)), OUT_OF_SCOPE[0])
        .when(F.col("market_end_ms") - F.col("market_start_ms") != scope.duration_s * 1000, "unexpected duration")
        .when(~F.col("__one"), "not one market")
        .when(no((F.col("__outcomes") == F.array(F.lit("Up"), F.lit("Down"))) & (F.size("__tokens") == 2)), "unexpected outcome mapping")
    )
    if scope.settled:
        reason = reason.when(no(F.size("__prices") >= 0) | F.exists("__prices", lambda x: x.isNull()), "prices are not numbers").when(~pair(1.0, 0.0) & ~pair(0.0, 1.0), OUT_OF_SCOPE[1])
    fees = F.col("fees_enabled")
    reason = (
        reason.when(fees & F.col("__rate").isNull(), "fees without a rate")
        .when(fees & ((F.col("__rate") < 0) | (F.col("__exponent") != 1) | ~F.col("__taker")), "unsupported fee schedule")
        .when(~F.col("condition_id").rlike("^0x.{64}$"), "invalid condition id")
    )
    return d.withColumns({
        "reason": reason, "token_up": F.col("__tokens")[0], "token_down": F.get("__tokens", F.lit(1)), "outcome_up": F.when(pair(1.0, 0.0), 1.0).when(pair(0.0, 1.0), 0.0), "fee_rate": F.when(fees, F.col("__rate")).otherwise(0.0), "fee_exponent": F.when(fees, F.col("__exponent")).otherwise(1.0),
    })


def markets(documents: DataFrame, text: str, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): typed rows, one a condition id, and the input's columns with the reason."""
    p = parsed(documents, text, scope)
    good = p.where("reason IS NULL").select(*FIELDS).distinct()
    n = good.groupBy("condition_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = good.join(n.where("__n = 1").select("condition_id"), "condition_id", "left_semi").select(*FIELDS)
    twice = p.where("reason IS NULL").join(n.where("__n > 1").select("condition_id"), "condition_id", "left_semi").select(*documents.columns, F.lit("conflicting records").alias("reason"))
    return rows, p.where("reason IS NOT NULL").select(*documents.columns, "reason").unionByName(twice)


def mapped(records: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) after a cross-check of tokens: mapping has (condition_id, token_id, outcome) of another source, which must
    name the same two tokens with the same outcomes. rejects: (condition_id, reason)."""
    other = mapping.groupBy(F.lower("condition_id").alias("condition_id")).agg(F.max(F.when(F.col("outcome") == "Up", F.col("token_id"))).alias("__up"), F.max(F.when(F.col("outcome") == "Down", F.col("token_id"))).alias("__down"), F.count_distinct("token_id").alias("__n"))
    j = records.join(other, "condition_id", "left")
    reason = F.when(F.col("__n").isNull(), "no mapping").when(~((F.col("__n") == 2) & F.col("token_up").eqNullSafe(F.col("__up")) & F.col("token_down").eqNullSafe(F.col("__down"))), "tokens differ")
    j = j.withColumn("reason", reason)
    return j.where("reason IS NULL").select(*records.columns), j.where("reason IS NOT NULL").select("condition_id", "reason")
