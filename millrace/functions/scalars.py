"""Scalar expressions. All are column expressions inside whole-stage code; none is a UDF.

Missing numbers are NULL; readers turn NaN into NULL (`missing`), because Spark orders NaN above
everything. `state_bin` alone treats a missing value as the last bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges up to which comparisons are chained.
CHAIN = 9


def missing(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def uniform_edges(n: int) -> list[float]:
    """n + 1 edges of [0, 1]; the last just above 1, so that 1 has a bin."""
    return [k / n for k in range(n)] + [1.000001]


def passed(value: Column, edges: Sequence[float], at: bool = False) -> Column:
    """How many edges lie below the value (at: or equal it). Many are counted in an array: a long chain of comparisons makes a
    method that the JVM never compiles, with all that stands beside it."""
    over = lambda e: value >= e if at else value > e
    if len(edges) > CHAIN:
        return F.coalesce(F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), over)), F.lit(0))
    return sum((F.when(over(e), 1).otherwise(0) for e in edges), F.lit(0))


def state_bin(value: Column, edges: list[float]) -> Column:
    """Right-closed bins: how many inner edges lie below the value."""
    inside = passed(value, edges[1:-1])
    return F.when(value.isNull() | F.isnan(value), len(edges) - 2).otherwise(inside).cast("int")


def round_half_even(x: Column, decimals: int) -> Column:
    scale = float(10**decimals)
    return F.rint(x * scale) / scale


def fee_per_share(price: Column, rate: Column | float, exponent: Column | float = 1.0) -> Column:
    curve = price * (1 - price)
    return _lit(rate) * (curve if not isinstance(exponent, Column) and exponent == 1.0 else F.pow(curve, _lit(exponent)))


def platform_fee(shares: Column, price: Column, rate: Column | float, decimals: int, exponent: Column | float = 1.0) -> Column:
    """Fee of one matched level, rounded as it is charged."""
    return round_half_even(shares * fee_per_share(price, rate, exponent), decimals)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def net_edge(probability: Column, ask: Column, rate: Column | float, extra: float, exponent: Column | float = 1.0) -> Column:
    return probability - ask - fee_per_share(ask, rate, exponent) - F.lit(extra)


def settlement(side: Column, outcome_up: Column) -> Column:
    return F.when(side == 0, outcome_up).otherwise(1 - outcome_up)


def logit(p: Column, clip: float = 1e-6) -> Column:
    x = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(x / (1 - x))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def recency_weight(age_days: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life_days)


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column, clip: float = 1e-12) -> Column:
    x = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.log(x) + (1 - y) * F.log(1 - x))


def profit_factor(profit: Column, loss: Column) -> Column:
    """profit / loss; infinite without losses, 0 without either."""
    return F.when(loss > 0, profit / F.when(loss > 0, loss)).when(profit > 0, F.lit(float("inf"))).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def price_index(text: Column) -> Column:
    """Place of a decimal text on the lattice of 1e-4 between 0 and 1; NULL if it is not on it."""
    ok = text.rlike(r"^(0(\.\d{1,4}0*)?|1(\.0*)?|\.\d{1,4}0*)$")
    return F.when(ok, F.rint(text.try_cast("double") * 10000).cast("int"))


def complement(price: Column) -> Column:
    return (F.lit(1).cast("decimal(5,4)") - price.cast("decimal(5,4)")).cast("decimal(5,4)")


def levels(text: Column) -> Column:
    """JSON pairs of price and size, as texts, to an array of numbers."""
    return F.transform(F.from_json(text, "array<array<string>>"), lambda p: F.struct(p[0].try_cast("double").alias("price"), p[1].try_cast("double").alias("size")))


def complement_levels(ls: Column) -> Column:
    return F.transform(ls, lambda x: F.struct((1 - x["price"]).alias("price"), x["size"].alias("size")))


def json_array(text: Column) -> Column:
    """A JSON array of texts, given as text (maybe quoted once more)."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return F.from_json(inner, "array<string>")


def event_type(message: Column) -> Column:
    """Kind of a raw feed message. A wrapped one (topic "market", an object as payload) has it in `type`, others in
    `event_type`; a message that does not say is known by the keys that it has, in this order."""
    text = lambda k: F.nullif(F.get_json_object(message, f"$.{k}"), F.lit(""))
    keys = F.json_object_keys(message)
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    every = lambda *names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names)
    wrapped = (F.get_json_object(message, "$.topic") == "market") & F.json_object_keys(F.get_json_object(message, "$.payload")).isNotNull()
    inferred = (
        F.when(every("bids", "asks"), "book")
        .when(has("price_changes", "priceChanges"), "price_change")
        .when(has("new_tick_size", "newTickSize"), "tick_size_change")
        .when(has("winning_asset_id", "winningTokenId"), "market_resolved")
        .when(every("best_bid", "best_ask", "spread"), "best_bid_ask")
        .when(every("price", "side"), "last_trade_price")
        .otherwise("unknown")
    )
    return F.when(wrapped, F.coalesce(text("type"), F.lit("unknown"))).otherwise(F.coalesce(text("event_type"), inferred))


def alias(message: Column, *keys: str) -> Column:
    """The first of several spellings of a field that the message has."""
    return F.coalesce(*(F.get_json_object(message, f"$.{k}") for k in keys))


# Names and spans looked for in titles, in order of priority.
ASSETS = (("BTC", ("bitcoin", "btc")), ("ETH", ("ethereum", "eth")), ("SOL", ("solana", "sol")), ("XRP", ("xrp",)), ("BNB", ("bnb", "binance coin")))
DURATIONS = (("5m", r"(?<!\d)5\s*m|-5m-"), ("15m", r"(?<!\d)15\s*m|-15m-"), ("1h", r"(?<!\d)1\s*h|hourly"), ("4h", r"(?<!\d)4\s*h"))


def classify_asset(title: Column) -> Column:
    """The first asset that stands in the title as a word."""
    t, out = F.lower(title), F
    for name, words in ASSETS:
        out = out.when(t.rlike(f"(?<![a-z])({'|'.join(words)})(?![a-z])"), name)
    return out.otherwise("OTHER")


def classify_duration(title: Column) -> Column:
    t, out = F.lower(title), F
    for name, pattern in DURATIONS:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("UNKNOWN")


def number(text: Column, default: float | None = 0.0) -> Column:
    """Lenient number: default where the text is none or not finite."""
    x = missing(text.try_cast("double"))
    return x if default is None else F.coalesce(x, F.lit(default))


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO text with an offset; NULL without one."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.unix_timestamp(F.try_to_timestamp(text)))


def epoch_seconds(raw: str) -> Column:
    """Seconds of a count of micro- or milliseconds (a column's name), told apart by size."""
    return F.expr(f"CASE WHEN {raw} >= 100000000000000 THEN {raw} DIV 1000000 ELSE {raw} DIV 1000 END")


def ceil_seconds(ms: str) -> Column:
    return F.expr(f"({ms} + 999) DIV 1000")


def hour_key(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH")


def e18(text: Column) -> Column:
    """Exact decimal of an integer text in units of 1e-18: the point is put in, nothing is divided."""
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(19)), F.lit("0"))
    return F.regexp_replace(padded, r"(\d{18})$", r".$1").cast("decimal(38,18)")


TICK_SIZES = ("0.1", "0.01", "0.001", "0.0001")


def tick_size(text: Column) -> Column:
    x = F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    return F.when(x.isin(*TICK_SIZES), x)


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of a row as JSON with sorted keys and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def reference_feed(url: Column) -> Column:
    u = F.lower(url)
    return F.when(u.contains("chain"), "oracle").when(u.contains("klines") | u.contains("ticker"), "exchange").otherwise("unknown")
