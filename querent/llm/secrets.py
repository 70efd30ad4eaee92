"""Secret scans: fixed patterns, and a randomness battery over long tokens with false-discovery control.

All of it is column expressions. Spark has no function for the places of all matches, but the parts between
matches (split) and the matches (regexp_extract_all) of one pattern alternate, so places are running sums of
their lengths. Long texts are cut where no match can lie across, and each stretch is scanned and redacted by itself,
so the work stays in proportion to the text, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType

from querent.llm.common import materialize

#: Fixed patterns, in the order in which kinds are listed. Letters of the keywords match in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6
#: Tokens that the battery looks at, and what a text needs for any kind.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ANY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}|(?i:password|passwd|secret|token|api_?key)"

#: Characters of a stretch of a long text, at most unless no cut is possible. A cut follows a character that no pattern
#: has, or a single blank between letters or digits, which none has either.
STRETCH = 4_000
CUT = r"""(?:(?<=[^A-Za-z0-9+/_.=:"'\x20-])|(?<=[A-Za-z0-9]\x20)(?=[A-Za-z0-9])|\z)"""
STRETCHES = rf"(?s).{{1,{STRETCH}}}{CUT}|.{{{STRETCH},}}?{CUT}"

#: Encodings, most special first: pattern, alphabet, and sums of squares and cubes of the symbol frequencies
#: that unrandom strings of it have (letters of prose; digits in hexadecimal; uniform digits).
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    (r"^[0-9]+$", DIGITS, 0.1, 0.01),
    (r"^[0-9a-f]+$", DIGITS + "abcdef", 0.1, 0.01),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.1, 0.01),
    (r"^[a-z]+$", LOWER, 0.0655, 0.00535),
    (r"^[A-Z]+$", UPPER, 0.0655, 0.00535),
    (r"^[A-Z2-7]+$", UPPER + "234567", 0.0655, 0.00535),
    (r"^[a-z0-9]+$", LOWER + DIGITS, 0.0655, 0.00535),
    (r"^[A-Z0-9]+$", UPPER + DIGITS, 0.0655, 0.00535),
    (r"^[A-Za-z]+$", UPPER + LOWER, 0.0655, 0.00535),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.0655, 0.00535),
    (r"", UPPER + LOWER + DIGITS + "+/_-=", 0.0655, 0.00535),
)
#: The battery rejects randomness where the sum of its squared scores is over this: one in 10,000 random
#: tokens, as chi-squared with three degrees of freedom.
REJECT = 21.1
#: Wanted share of false discoveries, and the lengths at which a class of tokens begins.
FALSE_SHARE = 0.01
LENGTHS = (20, 28, 40, 64, 128)
#: Strength of evidence is kept in tenths of a power of ten, up to this.
MOST_EVIDENCE = 400


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, own>>: places (code points) of the leftmost matches that don't overlap, and
    the matched group of each."""
    both = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("own"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,own:string>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        stop = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.struct(begin.alias("start"), stop.alias("end"), x["own"].alias("own"))
        found = F.when(x["hit"].isNotNull(), F.concat(state["found"], F.array(new))).otherwise(state["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(both, start, step)["found"]).otherwise(start["found"])


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end>> of the fixed patterns, in order; rank is the kind's place in KINDS."""
    assign = F.filter(spans(text, ASSIGN, 2), lambda x: F.length(x["own"]) >= LEAST_ASSIGNED)
    found = F.concat(_ranked(assign, 0), _ranked(spans(text, ACCESS), 1), _ranked(spans(text, HEX), 2))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.when(text.rlike(ANY), F.sort_array(found)).otherwise(none)


def _total(array: Column, of=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + of(x).cast("double"))


def battery(token: Column) -> Column:
    """struct<evidence, random>: random is whether the battery finds nothing against randomness; evidence is
    minus ten times the common logarithm of a bound on the probability that an unrandom token is as even."""

    def choose(part: int) -> Column:
        out = F.lit(ENCODINGS[-1][part])
        for e in reversed(ENCODINGS[:-1]):
            out = F.when(token.rlike(e[0]), F.lit(e[part])).otherwise(out)
        return out

    def bind(columns: dict[str, Column], then) -> Column:
        """A let: each column is worked out once and `then` gets a struct of them."""
        return F.transform(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))), then)[0]

    def with_symbols(e: Column) -> Column:
        symbols = F.transform(F.split(token, ""), lambda c: F.instr(e["alphabet"], c).cast("double"))
        size = F.length(e["alphabet"]).cast("double")
        return bind({"x": symbols, "k": size, "s2": e["s2"], "s3": e["s3"], "mean": _total(symbols) / F.size(symbols), "n": F.size(symbols).cast("double")}, with_counts)

    def with_counts(v: Column) -> Column:
        x, k, n, mean = v["x"], v["k"], v["n"], v["mean"]
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = lambda y: y > k / 2
        return bind({
            "n": n, "k": k, "s2": v["s2"], "s3": v["s3"],
            "squares": _total(F.array_distinct(x), lambda y: F.pow(F.size(F.filter(x, lambda z: z == y)).cast("double"), F.lit(2.0))),
            "above": F.size(F.filter(x, high)).cast("double"),
            "runs": 1.0 + F.size(F.filter(pairs, lambda p: high(p["a"]) != high(p["b"]))),
            "spread": _total(x, lambda y: (y - mean) * (y - mean)),
            "serial": _total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)),
        }, scores)

    def scores(v: Column) -> Column:
        n, k = v["n"], v["k"]
        chi = k / n * v["squares"] - n
        evenness = F.greatest((chi - (k - 1)) / F.sqrt(2 * (k - 1)), F.lit(0.0))
        product = 2 * v["above"] * (n - v["above"])
        variance = product * (product - n) / (n * n * (n - 1))
        runs = F.when(variance > 0, (v["runs"] - 1 - product / n) / F.sqrt(variance)).otherwise(F.lit(10.0))
        serial = F.when(v["spread"] > 0, (v["serial"] / v["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(10.0))
        usual = k - 1 + (n - 1) * (k * v["s2"] - 1)
        spread = k / n * F.sqrt(4 * n * n * n * F.greatest(v["s3"] - v["s2"] * v["s2"], F.lit(0.0)) + 2 * n * n * v["s2"] * v["s2"])
        z = F.greatest((usual - chi) / spread, F.lit(0.0))
        evidence = F.least(F.floor(10 * (0.30103 * F.when(z > 0, 1.0).otherwise(0.0) + 0.4342945 * z * z / 2)), F.lit(MOST_EVIDENCE))
        return F.struct(evidence.cast("int").alias("evidence"), (evenness * evenness + runs * runs + serial * serial <= REJECT).alias("random"))

    return bind({"alphabet": choose(1), "s2": choose(2), "s3": choose(3)}, with_symbols)


def tokens(text: Column, base: Column) -> Column:
    """array<struct<start, end, class, evidence, random>> of long tokens that don't overlap a base span."""
    apart = lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    kind = lambda n: F.aggregate(F.array(*map(F.lit, LENGTHS)), F.lit(0), lambda a, x: a + (n >= x).cast("int"))

    def judged(t: Column) -> Column:
        return F.transform(F.array(battery(t["own"])), lambda s: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), kind(t["end"] - t["start"]).alias("class"),
            s["evidence"].alias("evidence"), s["random"].alias("random"),
        ))[0]

    return F.transform(F.filter(spans(text, TOKEN), apart), judged)


def stretches(text: Column) -> Column:
    """array<string>: the whole text in stretches of which no match of any pattern has part of two."""
    return F.when(F.length(text) > 2 * STRETCH, F.regexp_extract_all(text, F.lit(STRETCHES), F.lit(0))).otherwise(F.array(text))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default all) with, for each stretch of the text, _querent_size (its characters),
    _querent_base (fixed patterns) and _querent_tokens (judged long tokens), whose places count from the stretch's
    begin. Texts without anything to look at have no stretches."""
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.when(text.rlike(ANY), stretches(text)).otherwise(F.array().cast("array<string>"))
    own = docs.select(*keep, *([] if text_col in keep else [text_col]), parts.alias("_querent_parts"))
    with_base = own.withColumn("_querent_base", F.transform("_querent_parts", base_spans))
    none = F.array().cast("array<struct<start:int,end:int,class:int,evidence:int,random:boolean>>")
    judged = F.zip_with("_querent_parts", "_querent_base", lambda t, base: F.when(t.rlike(ANY), tokens(t, base)).otherwise(none))
    return with_base.select(*keep, F.transform("_querent_parts", F.length).alias("_querent_size"), "_querent_base", judged.alias("_querent_tokens"))


def cutoffs(scanned: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """The least evidence at which a token of each class of lengths is a discovery (Benjamini-Hochberg).

    The tokens of a row are in one array, or in one for each stretch as scan() gives them.
    Tokens are counted by class and evidence: as many rows as those have values, whatever the input.
    Rounding evidence down makes the control stricter, never weaker.
    """
    several = isinstance(scanned.schema["_querent_tokens"].dataType.elementType, ArrayType)
    counted = scanned.select(F.explode(F.flatten("_querent_tokens") if several else F.col("_querent_tokens")).alias("t")).groupBy("t.class", "t.evidence").agg(F.count("*").alias("n"))
    up = W.partitionBy("class").orderBy(F.desc("evidence"))
    ranked = counted.select("class", "evidence", F.sum("n").over(up).alias("so_far"), F.sum("n").over(W.partitionBy("class")).alias("all"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("evidence") / 10) <= share * F.col("so_far") / F.col("all"))
    return {r["class"]: r["cut"] for r in passed.groupBy("class").agg(F.min("evidence").alias("cut")).collect()}


def discovered(cuts: dict[int, int]) -> Column:
    """array<array<struct<start, rank, end>>>: of each stretch the fixed patterns' spans and the tokens that the cutoffs
    and the battery pass, in order."""
    known = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)) if cuts else None
    if known is None:
        return F.col("_querent_base")
    good = lambda tokens_: F.filter(tokens_, lambda t: t["random"] & F.coalesce(t["evidence"] >= known[t["class"]], F.lit(False)))
    return F.zip_with("_querent_base", "_querent_tokens", lambda base, tokens_: F.sort_array(F.concat(base, _ranked(good(tokens_), 3))))


def placed(found: Column) -> Column:
    """Spans of all stretches in one array, with their places in the whole text."""
    begins = F.transform("_querent_size", lambda n, i: F.aggregate(F.slice("_querent_size", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    moved = lambda spans_, at: F.transform(spans_, lambda x: F.struct((x["start"] + at).alias("start"), x["rank"].alias("rank"), (x["end"] + at).alias("end")))
    return F.flatten(F.zip_with(found, begins, moved))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of docs.

    Null and empty texts have no spans (the sha256 is that of an empty string); repeated rows have equal
    results but all count for the false-discovery control; an empty table gives an empty result; other columns
    aren't read.
    """
    scanned = materialize(scan(docs, text_col, [id_col]), "secrets")
    found = scanned.withColumns({"_querent_all": placed(discovered(cutoffs(scanned, share))), "_querent_fixed": placed(F.col("_querent_base"))})
    count = lambda k: F.size(F.filter("_querent_all", lambda x: x["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, *(count(k) for k in range(4)), F.sha2(written(F.col("_querent_fixed")), 256).alias("base_sha256"), written(F.col("_querent_all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", share: float = FALSE_SHARE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in its text replaced by `mark`; rows and columns stay as they came.

    Spans that overlap or touch become one mark. Null texts stay null, empty ones empty; repeated rows are redacted
    alike but all count for the false-discovery control; an empty table gives an empty one. Each text is scanned
    once: docs and their spans are written, as the cutoffs need all of them. Names that begin with _querent_ are taken.
    """
    scanned = materialize(scan(docs, text_col), "scanned")
    found = scanned.withColumn("_querent_all", discovered(cutoffs(scanned, share)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cleaned(part: Column, spans_: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            between = F.substring(part, state["at"] + 1, x["start"] - state["at"])
            out = F.when((x["start"] > state["at"]) | (state["at"] == 0), F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

        whole = F.transform(F.array(F.aggregate(spans_, start, step)), lambda s: F.concat(s["out"], F.substring(part, s["at"] + 1, F.length(part))))[0]
        return F.when(F.size(spans_) > 0, whole).otherwise(part)

    clean = F.array_join(F.zip_with(stretches(F.col(text_col)), "_querent_all", cleaned), "")
    any_ = F.exists("_querent_all", lambda x: F.size(x) > 0)
    return found.withColumn(text_col, F.when(any_, clean).otherwise(F.col(text_col))).select(docs.columns)
