"""Mixing sources to target weights by iterative proportional fitting (raking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querent.llm.common import discard, materialize, small

#: Without target weights, a marginal's shares are its token shares to this power, normalised.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of all tokens that a sample is to have.
KEEP = 0.7
#: Rounds of fitting between two looks at the error, the largest relative error to stop at, and most looks.
ROUNDS, ERROR, LOOKS = 4, 1e-6, 12
#: Up to so many cells the fitting runs in one task, without shuffles.
CELLS_IN_A_TASK = 100_000
#: Most steps in which cells that are kept whole are found; each finds at least one.
MOST_CAPS = 60
SEED = 7
MISSING = "(none)"


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    first, last = F.element_at(parts, 1) == "", F.element_at(parts, -1) == ""
    return (F.size(parts) - first.cast("int") - (last & (F.size(parts) > 1)).cast("int")).cast("long")


def kind_of_text(text: Column, words: Column) -> Column:
    """A stand-in for a topic where documents have none: a kind of text by length, marks and lines."""
    t = F.coalesce(text, F.lit(""))
    marks = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(words < 50, "short").when(marks > 0.2 * words, "marked").when(lines * 8 > words, "lines")
        .when(words >= 1500, "long").otherwise("prose")
    )


def cell_columns(docs: DataFrame, text_col: str, topic: Column | None) -> DataFrame:
    """docs with _mix_tokens, _mix_source, _mix_lang and _mix_topic; null sources and languages form a group of their own."""
    with_words = docs.withColumn("_mix_tokens", word_count(F.col(text_col)))
    own = kind_of_text(F.col(text_col), F.col("_mix_tokens")) if topic is None else topic
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"_mix_{c}")
    return with_words.select("*", name("source"), name("lang"), F.coalesce(own.cast("string"), F.lit(MISSING)).alias("_mix_topic"))


def _targets(cells: DataFrame, d: str, total: float, given: DataFrame | None) -> DataFrame:
    """(_mix_d, _to_d): the tokens that each value of a dimension is to have; they add up to the total."""
    own = cells.groupBy(f"_mix_{d}").agg(F.sum("tokens").cast("double").alias("own"))
    if given is None:
        to = own.select(f"_mix_{d}", F.pow("own", F.lit(FLATTEN[d])).alias("to"))
    else:
        share = given.groupBy(F.col("value").cast("string").alias(f"_mix_{d}")).agg(F.sum("share").cast("double").alias("to"))
        to = own.select(f"_mix_{d}").join(share, f"_mix_{d}", "left").select(f"_mix_{d}", F.coalesce("to", F.lit(0.0)).alias("to"))
    to = materialize(to, "targets")
    every = to.agg(F.sum("to")).first()[0]
    return to.select(f"_mix_{d}", (F.col("to") * (total / every if every else 0.0)).alias(f"_to_{d}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (_mix_source, _mix_lang, _mix_topic, tokens) with `weight`, the factor on each cell's tokens.

    Weighted tokens have the target shares of each marginal and the total of the tokens. targets: for
    'source', 'lang' or 'topic' a table (value, share); values without a share get none of the tokens, shares
    of values that don't occur are spread over the others. Without: FLATTEN. Fitting stops when every
    marginal is within ERROR, or after LOOKS looks when targets contradict each other or the cells. Cells
    without any tokens among them all have weight 1.

    Up to CELLS_IN_A_TASK cells are fitted in one task; of more, each marginal is summed up and joined to the cells.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    one = cells.count() <= CELLS_IN_A_TASK
    now = cells.withColumn("weight", F.lit(1.0))
    for d in FLATTEN:
        now = now.join(small(_targets(cells, d, float(total), (targets or {}).get(d))), f"_mix_{d}")
    now = materialize(now, "cells")
    fit = _fit_in_a_task if one else _fit_by_marginals
    for _ in range(LOOKS):
        after = materialize(fit(now), "cells")
        discard(now)
        worst = after.agg(F.max("_off")).first()[0]
        now = after
        if worst <= ERROR:
            break
    return now.select("_mix_source", "_mix_lang", "_mix_topic", "tokens", "weight")


def _scaled(d: str) -> Column:
    return F.when(F.col("_has") > 0, F.col("weight") * F.col(f"_to_{d}") / F.col("_has")).otherwise(0.0)


def _error(d: str) -> Column:
    return F.when(F.col(f"_to_{d}") > 0, F.abs(F.col("_has") / F.col(f"_to_{d}") - 1)).otherwise(0.0)


def _fit_in_a_task(now: DataFrame) -> DataFrame:
    """ROUNDS rounds over all dimensions, and _off, the relative error of each cell's worst marginal."""
    columns = [c for c in now.columns if c != "_off"]
    now = now.select(*columns).coalesce(1)
    has = lambda d: F.sum(F.col("weight") * F.col("tokens")).over(W.partitionBy(f"_mix_{d}"))
    for _ in range(ROUNDS):
        for d in FLATTEN:
            now = now.withColumn("_has", has(d)).withColumn("weight", _scaled(d))
    now = now.withColumn("_off", F.lit(0.0))
    for d in FLATTEN:
        now = now.withColumn("_has", has(d)).withColumn("_off", F.greatest("_off", _error(d)))
    return now.select(*columns, "_off")


def _fit_by_marginals(now: DataFrame) -> DataFrame:
    """The same by sums of each marginal, which are written and joined to the cells."""
    columns = [c for c in now.columns if c != "_off"]
    now = now.select(*columns)

    def with_sums(cells: DataFrame, d: str) -> DataFrame:
        return cells.join(small(materialize(cells.groupBy(f"_mix_{d}").agg(F.sum(F.col("weight") * F.col("tokens")).alias("_has")), "marginal")), f"_mix_{d}")

    for _ in range(ROUNDS):
        for d in FLATTEN:
            now = with_sums(now, d).withColumn("weight", _scaled(d)).drop("_has")
    now = now.withColumn("_off", F.lit(0.0))
    for d in FLATTEN:
        now = with_sums(now, d).withColumn("_off", F.greatest("_off", _error(d))).drop("_has")
    return now.select(*columns, "_off")


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with `probability`: weight times one factor, at most 1, so that the expected tokens are `keep` of all.

    Cells whose product is over 1 are kept whole, and the factor for the others makes up for it; as that raises
    it, this is repeated until no further cell is over 1. Where even that can't give the wanted tokens (cells of
    weight zero hold too many), all other cells are kept whole. Without any tokens, or with keep above 1, the
    factor is keep, at most 1.
    """
    weight, tokens = F.col("weight"), F.col("tokens")
    wanted = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = keep
    capped = F.lit(False)
    for _ in range(MOST_CAPS if wanted else 0):
        full, rest, n = cells.agg(F.sum(F.when(capped, tokens)), F.sum(F.when(~capped, weight * tokens)), F.count_if(capped)).first()
        factor = (wanted - (full or 0)) / rest if rest else float("inf")
        capped = weight * F.lit(factor) >= 1
        if not rest or cells.where(capped).count() == n:
            break
    p = F.when(weight <= 0, 0.0).when(F.lit(factor == float("inf")), 1.0).otherwise(F.least(weight * F.lit(factor), F.lit(1.0)))
    return cells.select("_mix_source", "_mix_lang", "_mix_topic", "tokens", "weight", p.alias("probability"))


def draw(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that a row's id fixes."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(1 << 53))


def weighed(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, topic: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
) -> DataFrame:
    """docs with _mix_tokens, _mix_source, _mix_lang, _mix_topic, _mix_weight, _mix_probability and _mix_kept.

    Tokens are summed by cell before they are shuffled, and the cells, whose number is that of the
    combinations that occur, are broadcast after a count; otherwise they are joined by shuffle. So no
    source, however large, meets in one task. Repeated rows are drawn alike; texts without words weigh
    nothing but are drawn like the rest of their cell, and a table without any words is drawn at `keep`; rows
    with a null id share one draw; null sources and languages are a value of their own; an empty table gives an
    empty result. Further columns stay; names that begin with _mix_ are taken.
    """
    celled = cell_columns(docs, text_col, topic)
    cells = materialize(celled.groupBy("_mix_source", "_mix_lang", "_mix_topic").agg(F.sum("_mix_tokens").alias("tokens")), "cells")
    fitted = materialize(probabilities(rake(cells, targets), keep), "fitted")
    discard(cells)
    fitted = fitted.select("_mix_source", "_mix_lang", "_mix_topic", F.col("weight").alias("_mix_weight"), F.col("probability").alias("_mix_probability"))
    return celled.join(small(fitted), ["_mix_source", "_mix_lang", "_mix_topic"]).withColumn("_mix_kept", draw(id_col, seed) < F.col("_mix_probability"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, kept) for every row of docs; see weighed().

    Without the option `topic`, topic is the stand-in of kind_of_text(): a kind of text, not what it is about.
    """
    out = weighed(docs, id_col=id_col, **options)
    return out.select(id_col, "source", "lang", *(F.col(f"_mix_{a}").alias(b) for a, b in (("topic", "topic"), ("tokens", "n_tokens"), ("weight", "weight"), ("probability", "probability"), ("kept", "kept"))))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with their columns as they came; see weighed() for nulls, empty texts and repeats."""
    return weighed(docs, **options).where("_mix_kept").select(docs.columns)
