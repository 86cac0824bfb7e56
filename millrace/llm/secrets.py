"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and hex runs. Beyond them, tokens are scored by two
character Markov models of order one, random strings against ordinary identifiers: the
log-likelihood ratio of a token is the sum over its character pairs. The models are trained from a
labelled sample (columns token, is_secret); `labelled_sample` makes one by rule, natively.

Positions come from splitting a text at a pattern: the lengths of the gaps and of the matches, in
turn, add up to each match's place. Every pass over a text or its matches is linear, so a very long
text takes time in proportion to its length and its number of matches.

Defined results: a null text is empty and has no spans; repeated rows are scanned each; only the
named columns are kept, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, keyed_text

# The base rules' patterns and least lengths.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Numbers that running totals take at once, and characters of a piece of a text to mask.
BLOCK, PIECE = 64, 1024
MARKOV_RANK = 3

#: Tokens that the models look at: this many characters or more, of two kinds at least among lower-case
#: letters, upper-case letters and digits.
CANDIDATE = r"[A-Za-z0-9+/_=-]+"
LEAST_TOKEN = 12
#: A token is a secret if its ratio, in nats a character pair, exceeds THRESHOLD and in all EVIDENCE.
THRESHOLD, EVIDENCE = 0.35, 6.5
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# Parts of ordinary identifiers for the labelled sample.
PARTS = "get set user name account value index count list item file path data time date config server client request response handler manager service table column record buffer stream number string object default current next first last update delete create insert select version image image2 page page1 test test3 v2 2024 01 10 100 2023 http www com html index7 section chapter report summary final about above action active address after again against almost amount animal answer around balance because before better between black board body book bottom bring brother build business call carry center change check child choice city class close color common company control country course cover cross dark delivery design detail differ direct distance document double early earth edge effect engine enough event every example family father field figure finish flower follow force forest friend front garden general glass government great green ground group happen health heart history house hundred important interest island kitchen language large leave letter light little local machine market material matter member middle minute money morning mother mountain music nature never night north notice office order other paper parent pattern people picture place plant point power present problem process product program public question quick".split()


def labelled_sample(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """(token, is_secret): n random strings in base64, hex and letters with digits, and n identifiers
    of three to six ordinary parts, in three styles. Each follows from its number alone."""
    bits = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary"), 256)
    base64 = F.base64(F.unhex(bits("a")))
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(bits("b"))), "[^A-Za-z0-9]", ""))
    token = F.when(F.col("id") % 4 == 0, F.substring(bits("c"), 1, 40)).when(F.col("id") % 4 == 1, upper).when(F.col("id") % 4 == 2, F.regexp_replace(base64, "[+/=]", "")).otherwise(base64)
    random = spark.range(n).select(token.alias("token"), F.lit(True).alias("is_secret"))
    parts = F.array(*map(F.lit, PARTS))
    at = lambda i: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    chosen = F.slice(F.array(*(at(i) for i in range(6))), F.lit(1), (F.col("id") % 4 + 3).cast("int"))
    style = F.when(F.col("id") % 3 == 0, F.array_join(chosen, "_")).when(F.col("id") % 3 == 1, F.array_join(chosen, "-")).otherwise(F.array_join(F.transform(chosen, F.initcap), ""))
    plain = spark.range(n).select(style.alias("token"), F.lit(False).alias("is_secret"))
    return random.unionByName(plain)


def train(sample: DataFrame, even: float = 0.2) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary: a model of
    len(ALPHABET) squared numbers, whatever the sample's size. Each model is a mixture of the sample's
    shares of what follows a character with even odds, since samples hold few of all ordinary words."""
    k = len(ALPHABET)
    t = F.regexp_replace(F.coalesce("token", F.lit("")), f"[^{ALPHABET}]", "")
    pairs = (
        sample.where(F.col("is_secret").isNotNull() & (F.length(t) >= 2))
        .select("is_secret", F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).alias("pair"))
        .groupBy("is_secret", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    count = {s: [[0] * k for _ in range(k)] for s in (True, False)}
    place = {c: i for i, c in enumerate(ALPHABET)}
    for r in pairs.collect():  # 2 x 67 x 67 rows at most
        count[r["is_secret"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["n"]
    chance = lambda s, a, b: even / k + (1 - even) * (count[s][a][b] / sum(count[s][a]) if sum(count[s][a]) else 1 / k)
    return [math.log(chance(True, a, b)) - math.log(chance(False, a, b)) for a in range(k) for b in range(k)]


def _with(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often use looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op) -> Column:
    """Running totals of numbers of 0 or more under op (a sum or a maximum). An array that grows in an
    aggregate is copied at each step, so totals run within blocks of BLOCK, from the totals before them."""

    def plain(a: Column, first: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(first), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v)))), F.lit(2), F.size(a))

    def over(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
        return _with(plain(sums, F.lit(0)), lambda upto: F.flatten(F.transform(blocks, lambda b, i: plain(b, F.coalesce(F.get(upto, i - 1), F.lit(0))))))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK)))
    return _with(values, lambda a: F.when(F.size(a) > 0, _with(cut(a), over)).otherwise(a))


def _ends(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (start, end) in code points of each match of pattern; end exclusive."""
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("gap"), F.length(m).alias("size")))

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda s: s["gap"] + s["size"]), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda s, e: F.struct((e - s["size"]).alias("start"), e.alias("end")))

    return _with(F.filter(steps, lambda s: s["size"].isNotNull()), placed)


def _outside(spans: Column) -> Column:
    """Spans in order without those of the models that lie inside a base span: the furthest end of the
    base spans that start no later tells."""
    base = lambda s: s["rank"] < MARKOV_RANK

    def kept(all_: Column) -> Column:
        reach = _running(F.transform(all_, lambda s: F.when(base(s), s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        seen = F.zip_with(all_, reach, lambda s, e: F.struct(s.alias("span"), (base(s) | (s["end"] > e)).alias("keep")))
        return F.transform(F.filter(seen, lambda x: x["keep"]), lambda x: x["span"])

    return _with(spans, kept)


def _kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """df with base (array of start, rank, end, kind of the base rules), markov (those that the
    models add: not inside a base span) and spans (both, by start)."""
    text = F.col(text_col)
    none = F.array().cast("array<struct<start:int,end:int>>")
    # Group 2 is what follows the key and its signs: a match's tail.
    assign_at = F.regexp_extract_all(text, F.lit(f"({ASSIGN})({VALUE})"), F.lit(0))
    value_at = F.regexp_extract_all(text, F.lit(f"({ASSIGN})({VALUE})"), F.lit(2))
    with_value = F.zip_with(_ends(text, ASSIGN + VALUE, assign_at), value_at, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("size")))
    assign = F.transform(F.filter(with_value, lambda s: s["size"] >= LEAST["assign"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    long_enough = lambda pattern, least: pattern[:-1] + f"{{{least},}}"  # noqa: E731  the same matches: a run that is too short holds no longer one
    access = long_enough(ACCESS, LEAST["access"] - 4)
    hexes = long_enough(HEX, LEAST["hex"])
    tokens = f"{CANDIDATE[:-1]}{{{LEAST_TOKEN},}}"
    hits = lambda p: F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(0))
    d = df.withColumns(
        {
            "__assign": F.when(text.rlike(ASSIGN), assign).otherwise(none),
            "__access": F.when(F.contains(text, F.lit("AKIA")), _ends(text, access, hits(access))).otherwise(none),
            "__hex": F.when(text.rlike(hexes), _ends(text, hexes, hits(hexes))).otherwise(none),
            "__hits": F.when(text.rlike(tokens), hits(tokens)).otherwise(F.array().cast("array<string>")),
        }
    )
    d = d.withColumn("__at", F.when(F.size("__hits") > 0, _ends(text, tokens, F.col("__hits"))).otherwise(none))
    llr, k = F.array(*map(F.lit, model)), len(ALPHABET)

    def ratio(t: Column) -> Column:
        places = F.transform(F.split(t, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        total = F.aggregate(
            places,
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda acc, p: F.struct(p.cast("int").alias("last"), (acc["sum"] + F.when((acc["last"] >= 0) & (p >= 0), F.element_at(llr, (acc["last"] * k + p + 1).cast("int"))).otherwise(0.0)).alias("sum")),
        )
        return total["sum"]

    kinds = lambda t: sum(t.rlike(k).cast("int") for k in ("[0-9]", "[a-z]", "[A-Z]"))
    scored = F.zip_with("__at", "__hits", lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(t).alias("size"), F.when(kinds(t) >= 2, ratio(t)).alias("llr")))
    base = F.array_sort(F.concat(_kind(F.col("__assign"), "assign", 0), _kind(F.col("__access"), "access", 1), _kind(F.col("__hex"), "hex", 2)))
    d = d.withColumn("base", base)
    likely = F.filter(scored, lambda s: s["llr"] > F.greatest(threshold * (s["size"] - 1), F.lit(EVIDENCE)))
    spans = _outside(F.array_sort(F.concat("base", _kind(likely, "markov", MARKOV_RANK))))
    d = d.withColumn("spans", spans).withColumn("markov", F.filter("spans", lambda s: s["rank"] == MARKOV_RANK))
    return d.drop("__assign", "__access", "__hex", "__hits", "__at")


def redact(df: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """df of `scan` with every span of its texts replaced by mask; overlapping spans become one mask."""
    text = F.col(text_col)
    masked = F.size("spans") > 0
    reach = _running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    # Each mask with the text before it, which is looked up in pieces of PIECE characters.
    before = _with(reach, lambda e: F.transform("spans", lambda s, i: F.struct(F.coalesce(F.get(e, i - 1), F.lit(0)).alias("from"), s["start"].alias("to"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))

    def part(p: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        near = F.slice(p, first + 1, F.floor(b / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(near, ""), a - first * PIECE + 1, b - a)

    parts = _with(pieces, lambda p: F.transform(F.filter(before, lambda x: x["from"] <= x["to"]), lambda x: F.concat(part(p, x["from"], x["to"]), F.lit(mask))))
    end = F.array_max(F.transform("spans", lambda s: s["end"]))
    done = F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))
    return df.withColumn(text_col, F.when(masked, done).otherwise(text))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(keyed_text(documents(spark, sf_dir)), train(labelled_sample(spark)))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("markov").cast("long").alias("n_markov")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the spans found in docs' texts; null texts stay null, n_chars follows."""
    d = docs.select(F.struct(*docs.columns).alias("__doc"), F.coalesce("text", F.lit("")).alias("text"))
    d = redact(scan(d, train(labelled_sample(spark))))
    text = F.when(F.col("__doc.text").isNotNull(), F.col("text"))
    parts = {c: F.col(f"__doc.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        parts["n_chars"] = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("__doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*(parts[c].alias(c) for c in docs.columns))
