"""Sampling by hash order, few-shot selection, sharding.

Orders come from a hash of the id and a seed, so they are the same on any cluster; no order of a random
generator is reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querent.functions.text import jaccard

SEED = 42
#: Up to so many rows are ranked by a top-k; hashes are counted by so many more of their digits at a time.
TOP, DIGITS = 10_000, 3
#: Complexities that questions may have where examples are selected by it.
LEVELS = 100


def shuffled(id_col: str, seed: int = SEED) -> Column:
    """The place of a row in the shuffled table, as a text of 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_range(df: DataFrame, id_col: str, n: int, offset: int = 0, seed: int = SEED) -> DataFrame:
    """Rows offset to offset + n of the shuffled table (fewer at its end), in no order. Rows of one id are in the order of
    a hash of all their columns; only of rows that are equal in all of them does it not matter which is taken.

    Few rows are a top-k. For more, the places at which the sample begins and ends are found from counts by their
    first digits, and the rows between them are filtered, so that they are neither sorted nor meet in one task.
    Both ways give the same rows: the place is the id's hash, then the row's, and of equal rows at a place where the
    sample begins or ends as many are taken as belong to it.
    """
    key = place_of(df, id_col, seed)
    if offset + n <= TOP:
        return df.orderBy(key).offset(offset).limit(n)
    if n <= 0:
        return df.limit(0)
    places = df.select(key.alias("h"))
    low, high = cut(places, offset), cut(places, offset + n)
    if low is None:
        return df.limit(0)
    before_low, before_high = low[1], high[1] if high else 0
    if high is not None and high[0] == low[0]:
        return df.where(key == low[0]).limit(n)
    inside = df.where((key > low[0]) & (key < high[0]) if high else key > low[0])
    first = df.where(key == low[0])
    if before_low:  # of equal rows, those that aren't before the sample
        first = first.limit(first.count() - before_low)
    last = df.where(key == high[0]).limit(before_high) if high and before_high else None
    return inside.unionByName(first) if last is None else inside.unionByName(first).unionByName(last)


def place_of(df: DataFrame, id_col: str, seed: int = SEED) -> Column:
    """A row's place in the shuffled table: its id's hash, then a hash of all its columns."""
    return F.concat(shuffled(id_col, seed), F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))


def cut(places: DataFrame, rank: int) -> tuple[str, int] | None:
    """The place (column h, of 64 digits) that stands at a rank, from 0, in rising order, and how many of the rows with
    just this place are before the rank; None beyond the end."""
    begun, left = "", rank
    while True:
        now = places.where(F.startswith("h", F.lit(begun)))
        counts = sorted(tuple(r) for r in now.groupBy(F.left("h", F.lit(len(begun) + DIGITS))).agg(F.count("*").alias("n")).collect())
        for prefix, n in counts:
            if left < n:
                begun = prefix
                break
            left -= n
        else:
            return None
        if n <= TOP or len(begun) >= 64:
            for place, same in sorted(tuple(r) for r in places.where(F.startswith("h", F.lit(begun))).groupBy("h").agg(F.count("*").alias("n")).collect()):
                if left < same:
                    return place, left
                left -= same


def sample_percent(df: DataFrame, id_col: str, percent: float, seed: int = SEED, shuffle: bool = False) -> DataFrame:
    """floor(rows * percent / 100) rows; all at 100 or more. shuffle: in the order of the shuffled table, even then."""
    out = df if percent >= 100 else sample_range(df, id_col, int(df.count() * percent / 100), seed=seed)
    return out.orderBy(shuffled(id_col, seed), id_col) if shuffle else out


def sample_different_from(df: DataFrame, used: DataFrame, id_col: str, n: int, column: str = "question", offset: int = 0, seed: int = SEED) -> DataFrame:
    """Rows offset to offset + n of the shuffled table of those whose text isn't among the used ones."""
    return sample_range(exclude_used(df, used, column), id_col, n, offset, seed)


def exclude_used(df: DataFrame, used: DataFrame, column: str = "question") -> DataFrame:
    """Rows whose text is not among the used ones; null texts stay and so do repeats."""
    return df.join(used.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_anti").select(df.columns)


def shard(df: DataFrame, id_col: str, rank: int, of: int, seed: int = SEED) -> DataFrame:
    """The rows of one of `of` shards, by the first eight digits of their hash."""
    return df.where(F.pmod(F.conv(F.left(shuffled(id_col, seed), F.lit(8)), 16, 10).cast("long"), F.lit(of)) == rank)


def few_shot_specific(questions: DataFrame, pool: DataFrame, k: int, content: str | None = None) -> DataFrame:
    """(qid, pool_id, same_complexity, jaccard, rank): for each question the k most alike of the pool.

    Both have (qid, complexity, types array), the pool pool_ord; alike is same complexity first, then Jaccard of the
    types, then pool order. A question is not its own example; content names a column of both (not null) by which
    that is told, else it is the id.

    Questions and pool entries of one complexity and set of types are alike to all, so these kinds are compared, not the
    rows: an entry can only be chosen if it is among the first k + 1 of its kind, or k + 1 differ in content. Kinds meet
    by the types they share; those that share none are only chosen by pool order, of which the first of the question's
    complexity and of the others are enough, see firsts().
    """
    same = content or "qid"
    own_columns = ["qid", "complexity", "types"] + ([content] if content else [])
    types = F.array_sort(F.array_distinct("types"))
    q = questions.select(*own_columns).withColumn("types", types)
    entries = pool.select(*own_columns, "pool_ord").withColumn("types", types)
    # of entries that are equal in all that counts, k come first
    first = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("pool_ord"))
    p = entries.withColumn("_r", first("complexity", "types", same)).where(F.col("_r") <= k)
    p = p.withColumn("_f", first_seen("complexity", "types", same)).withColumn("_d", F.dense_rank().over(W.partitionBy("complexity", "types").orderBy("_f"))).where(F.col("_d") <= k + 1)
    p = p.select(F.col("qid").alias("pool_id"), F.col(same).alias("_same"), "pool_ord", F.col("complexity").alias("pc"), F.col("types").alias("pt"))
    kinds = q.select("complexity", "types").distinct()
    pool_kinds = p.select("pc", "pt").distinct()
    sharing = (
        kinds.select("complexity", "types", F.explode("types").alias("_t")).join(pool_kinds.select("pc", "pt", F.explode("pt").alias("_t")), "_t")
        .groupBy("complexity", "types", "pc", "pt").agg(F.count("*").alias("n")))
    alike = sharing.withColumn("jaccard", F.col("n") / (F.size("types") + F.size("pt") - F.col("n"))).drop("n")
    by_type = alike.join(p, ["pc", "pt"])
    any_ = kinds.join(F.broadcast(firsts(p, kinds, k)), "complexity").withColumn("jaccard", jaccard(F.col("types"), F.col("pt")))
    columns = ["complexity", "types", "pool_id", "_same", "pool_ord", "pc", "jaccard"]
    scored = by_type.select(*columns).union(any_.select(*columns)).distinct().withColumn("same_complexity", F.col("complexity") == F.col("pc"))
    order = [F.desc("same_complexity"), F.desc("jaccard"), F.asc("pool_ord")]
    mine = W.partitionBy("complexity", "types", "_same").orderBy(*order)
    best = W.partitionBy("complexity", "types").orderBy(F.desc("_best.s"), F.desc("_best.j"), F.asc("_best.o"))
    lead = F.first(F.struct(F.col("same_complexity").alias("s"), F.col("jaccard").alias("j"), F.col("pool_ord").alias("o"))).over(mine)
    top = scored.withColumn("_r", F.row_number().over(mine)).where(F.col("_r") <= k).withColumn("_best", lead)
    top = top.withColumn("_d", F.dense_rank().over(best)).where(F.col("_d") <= k + 1).drop("_r", "_d", "_best")
    met = q.select("qid", "complexity", "types", F.col(same).alias("_own")).join(top, ["complexity", "types"]).where("_own <> _same")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("qid", "pool_id", "same_complexity", "jaccard", "rank")


def firsts(p: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """p's rows with `complexity`: for each complexity of the questions the first of its own and the first of the others by
    pool order, of k + 1 contents and k rows of each. That are 2 * k * (k + 1) rows for each of at most LEVELS, more of
    which are an error."""
    levels = [r[0] for r in kinds.select("complexity").where("complexity is not null").distinct().limit(LEVELS + 1).collect()]
    if len(levels) > LEVELS:
        raise ValueError(f"more than {LEVELS} complexities")
    kind = kinds.schema["complexity"].dataType
    each = p.withColumn("complexity", F.explode(F.array(*map(F.lit, levels)).cast(f"array<{kind.simpleString()}>")))
    own = F.coalesce(F.col("pc") == F.col("complexity"), F.lit(False))
    each = each.withColumn("_own", own).withColumn("_r", F.row_number().over(W.partitionBy("complexity", "_own", "_same").orderBy("pool_ord"))).where(F.col("_r") <= k)
    by_content = each.groupBy("complexity", "_own", "_same").agg(F.min("pool_ord").alias("_f"))
    ranked = by_content.withColumn("_d", F.row_number().over(W.partitionBy("complexity", "_own").orderBy("_f", "_same"))).where(F.col("_d") <= k + 1)
    return each.join(ranked.select("complexity", "_own", "_same"), ["complexity", "_own", "_same"]).select("complexity", *p.columns)


def first_seen(*by: str) -> Column:
    """The smallest pool_ord among rows that are equal in some columns."""
    return F.min("pool_ord").over(W.partitionBy(*by))


def select_few_shot(questions: DataFrame, pool: DataFrame, k: int, selection: str = "random", shot_type: str = "mixed", leave_out: bool = True, seed: int = SEED) -> DataFrame:
    """(qid, place, pool_id, role): k examples for each question, in the order they are shown.

    handpicked: the first of the pool, always answerable. specific: few_shot_specific(). random: neighbours in the
    shuffled pool, from a place that a hash of the question's id gives. Roles are those of few_shot_roles(), of which
    mixed ones are then shuffled by a hash. leave_out: a question is not its own example (where the pool is the
    evaluation's own questions). The pool is numbered by ranges of its order, so it may be large.
    """
    if selection == "specific":
        kept = few_shot_specific(questions, pool, k).select("qid", "pool_id", F.col("rank").alias("n"))
    else:
        order = F.col("pool_ord") if selection == "handpicked" else shuffled("qid", seed)
        size = pool.count()
        reach = min(k + int(leave_out), size)
        if selection == "handpicked":
            few = pool.orderBy(order).limit(reach).select(F.col("qid").alias("pool_id"), "pool_ord").withColumn("at", F.row_number().over(W.partitionBy().orderBy("pool_ord")))
            met = questions.select("qid", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("at")) if reach else questions.select("qid", F.lit(1).alias("at")).limit(0)
        else:
            few = numbered(pool.select(F.col("qid").alias("pool_id"), order.alias("h")), size)
            start = F.pmod(F.conv(F.left(shuffled("qid", seed + 1), F.lit(12)), 16, 10).cast("long"), F.lit(max(size, 1)))
            met = questions.select("qid", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(max(reach - 1, 0)))).alias("i")).select("qid", "i", F.pmod(F.col("s") + F.col("i"), F.lit(max(size, 1))).alias("at"))
            met = met if reach else met.limit(0)
        found = met.join(F.broadcast(few) if selection == "handpicked" else few, "at")
        found = found.where(F.col("qid") != F.col("pool_id")) if leave_out else found
        nth = F.col("at") if selection == "handpicked" else F.col("i")
        kept = found.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(nth))).where(F.col("n") <= k).select("qid", "pool_id", "n")
    roles = few_shot_roles(k, "answerable" if selection == "handpicked" else shot_type)
    named = kept.withColumn("role", F.get(F.array(*map(F.lit, roles)), F.col("n") - 1) if roles else F.lit(None).cast("string"))
    mixed = shot_type == "mixed" and selection != "handpicked"
    shown = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string"), F.col("pool_id").cast("string"))) if mixed else F.col("n")
    return named.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(shown, "n"))).select("qid", "place", "pool_id", "role")


def numbered(pool: DataFrame, size: int) -> DataFrame:
    """(pool_id, at): rows (pool_id, h) numbered from 0 in the order of h and id. Hashes are spread evenly, so rows are numbered in
    parts by their first digits, and the parts' sizes are summed up."""
    digits = 0
    while size > TOP * 16**digits:
        digits += 1
    parts = pool.withColumn("part", F.left("h", F.lit(digits)))
    counts = parts.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", (F.sum("c").over(W.partitionBy().orderBy("part")) - F.col("c")).alias("before"))
    inside = parts.withColumn("i", F.row_number().over(W.partitionBy("part").orderBy("h", "pool_id")) - 1)
    return inside.join(before, "part").select("pool_id", (F.col("before") + F.col("i")).alias("at"))


def few_shot_roles(n: int, kind: str) -> list[str]:
    """Roles of n examples: all answerable, all unanswerable, or mixed with the first n // 2 answerable."""
    if kind == "mixed":
        return ["answerable"] * (n // 2) + ["unanswerable"] * (n - n // 2)
    return [kind] * n


def complete_examples(pool: DataFrame, pages: DataFrame) -> DataFrame:
    """Pool entries (qid, paths array) all of whose images exist."""
    gone = pool.select("qid", F.explode("paths").alias("path")).join(pages.select("path").distinct(), "path", "left_anti").select("qid").distinct()
    return pool.join(gone, "qid", "left_anti").select(pool.columns)


def head(df: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first rows by an ordinal; none or 0 means all."""
    return df.orderBy(order).limit(most) if most else df
