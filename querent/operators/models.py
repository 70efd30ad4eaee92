"""Where models come in: replaceable functions over batches, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.streaming.incremental import written


def generate(load: Callable[[], Callable[[list[str]], list[str]]]):
    """A vectorised function of prompts. load() runs once per Python worker and gives the model as a function of texts.

    Mark results as non-deterministic and write them to a table before they are used twice.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()), index=prompts.index)

    return run.asNondeterministic()


def mock() -> Callable[[list[str]], list[str]]:
    """A stand-in that answers with the number of characters of the prompt."""
    return lambda prompts: [f"mock answer {len(p or '')}" for p in prompts]


def evaluate(windows: DataFrame, prompt: Column, sides: list[str], model=None) -> DataFrame:
    """windows (…, side) of the wanted sides with the model's answer, and whether it is an error."""
    run = generate(model or mock)
    out = windows.where(F.col("side").isin(*sides)).withColumn("answer", run(prompt))
    return out.withColumn("is_error", F.startswith("answer", F.lit("Unable to determine - Error")))


def not_yet(questions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Questions without results in an earlier run."""
    return questions.join(done.select(*keys).distinct(), keys, "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if one of them is all zeros."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(total(a, a) * total(b, b))
    return F.when(length > 0, F.try_divide(total(a, b), length)).otherwise(0.0)


#: Categories of a block, of which one's means are held at once, those that are multiplied at once, and rows of a share.
BLOCK, AT_ONCE, SHARE = 4096, 512, 65_536


def nearest_means(vectors: list, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, mean cosine) of the mean of unit vectors that is most alike to each vector; of equal ones the first.

    Means are taken in falling order of their norms, which bound a cosine's mean: a vector drops out once no mean that is
    left can be above the best that it has. Vectors that are null, or of another length, or hold null are like none
    (-inf) and get the first; those of zeros are as much like one as like another.
    """
    place, best = np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), -np.inf)
    fine = [i for i, v in enumerate(vectors) if v is not None and len(v) == means.shape[1] and None not in v]
    if not fine or not len(means):
        return place, best
    own = np.array([vectors[i] for i in fine], dtype=np.float64)
    norm = np.sqrt((own * own).sum(axis=1, keepdims=True))
    own = np.divide(own, norm, out=np.zeros_like(own), where=norm > 0)
    size = np.sqrt((means * means).sum(axis=1))
    order = np.lexsort((np.arange(len(means)), -size))
    score, at, open_ = np.full(len(own), -np.inf), np.zeros(len(own), dtype=np.int64), np.arange(len(own))
    for low in range(0, len(order), AT_ONCE):
        some = np.sort(order[low : low + AT_ONCE])
        open_ = open_[score[open_] <= size[order[low]] * (1 + 1e-9) + 1e-12]
        if not len(open_):
            break
        dots = own[open_] @ means[some].T
        which = dots.argmax(axis=1)
        top = dots[np.arange(len(open_)), which]
        better = (top > score[open_]) | ((top == score[open_]) & (some[which] < at[open_]))
        score[open_[better]], at[open_[better]] = top[better], some[which[better]]
    place[fine], best[fine] = at, score
    return place, best


def nearest_category(queries: DataFrame, examples: DataFrame, id_col: str, vector: str, category: str, least: float | None = None) -> DataFrame:
    """(id, category): the category whose examples have the highest mean cosine; -1 if that is below `least`.

    The mean cosine to a category is the cosine part with the mean of its unit vectors, so a category is first
    brought down to one vector. Up to BLOCK categories, which are counted, go to every task. More are cut into blocks
    that meet the distinct vectors in shares, and a vector's best of each block are brought down to one. Either way
    ties go to the smallest category, see nearest_means(); without categories all have null. Examples without a category
    count for none.
    """
    import pyarrow as pa

    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    scale = F.when(norm > 0, F.try_divide(F.lit(1.0), norm)).otherwise(0.0)
    unit = examples.select(category, F.posexplode(F.transform(vector, lambda v: v * scale)).alias("i", "v"))
    mean = unit.groupBy(category, "i").agg(F.avg("v").alias("v")).groupBy(category).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))  # of one category: its components
    kinds = {c: queries.schema[c].dataType.simpleString() for c in (id_col,)} | {category: examples.schema[category].dataType.simpleString()}
    few = mean.orderBy(category).limit(BLOCK + 1).toArrow()

    def table_of(names: pa.Array, lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Categories in rising order and their means; such with null components are none."""
        rows = sorted(((n, m) for n, m in zip(names.to_pylist(), lists.to_pylist()) if n is not None and None not in m), key=lambda x: x[0])
        width = max((len(m) for _, m in rows), default=0)
        rows = [x for x in rows if len(x[1]) == width]
        return pa.array([n for n, _ in rows], names.type), np.array([m for _, m in rows], dtype=np.float64).reshape(len(rows), width)

    def named(names: pa.Array, place: np.ndarray, score: np.ndarray) -> pa.Array:
        return names.take(pa.array(place)) if len(names) else pa.nulls(len(place), names.type)

    chosen = F.col("category_") if least is None else F.when(F.col("score_") >= least, F.col("category_")).otherwise(-1)
    if few.num_rows <= BLOCK:
        known = table_of(few.column(0).combine_chunks(), few.column(1).combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                place, score = nearest_means(b.column(1).to_pylist(), known[1])
                yield pa.RecordBatch.from_arrays([b.column(0), named(known[0], place, score), pa.array(score)], names=[id_col, "category_", "score_"])

        found = queries.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, category_ {kinds[category]}, score_ double")
        return found.select(id_col, chosen.alias(category))
    mean = written(mean, "means")
    key = F.md5(F.coalesce(F.to_json(F.struct(F.col(vector).alias("v"))), F.lit("")))
    own = queries.select(F.col(id_col), F.col(vector), key.alias("key_"))
    distinct = own.groupBy("key_").agg(F.first(vector).alias("v_"))
    blocks, shares = -(-mean.count() // BLOCK), -(-distinct.count() // SHARE) or 1
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.select("key_", "v_", every(blocks).alias("block"), dealt("key_", shares).alias("share"))
    right = mean.select(F.col(category).alias("category_"), "mean", dealt(category, blocks).alias("block"), every(shares).alias("share"))

    def meet(some: pa.Table, means: pa.Table) -> pa.Table:
        names, table = table_of(means.column("category_").combine_chunks(), means.column("mean").combine_chunks())
        place, score = nearest_means(some.column("v_").to_pylist(), table)
        return pa.table({"key_": some.column("key_"), "category_": named(names, place, score), "score_": pa.array(score)})

    part = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(meet, f"key_ string, category_ {kinds[category]}, score_ double").where("category_ is not null")
    best = part.groupBy("key_").agg(F.max("score_").alias("score_")).join(part.withColumnRenamed("score_", "s_"), "key_").where("s_ = score_").groupBy("key_").agg(F.min("category_").alias("category_"), F.max("score_").alias("score_"))
    return own.join(best, "key_", "left").select(id_col, chosen.alias(category))


def rewrite_questions(variants: DataFrame, rewrite: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """variants (original_question, corrupted_question, corrupted_entities array<struct<text,…>>) with the distinct texts of the
    entities in order, the prompt, and the question as a model rewrites it, cleaned; without a model it stays."""
    from querent.functions.text import clean_generated, rewrite_prompt

    texts = F.transform("corrupted_entities", lambda e: e["text"])
    out = variants.withColumn("entities", F.array_distinct(F.filter(texts, lambda t: t.isNotNull())))
    out = out.withColumn("prompt", rewrite_prompt(F.col("original_question"), F.col("corrupted_question"), F.col("entities")))
    return out.withColumn("rewritten", F.col("corrupted_question") if rewrite is None else clean_generated(generate(lambda: rewrite)(F.col("prompt"))))


def route_text(objects: DataFrame, describe: Callable[[DataFrame], DataFrame], recognise: Callable[[DataFrame], DataFrame], described: tuple[str, ...] = ("table", "figure")) -> DataFrame:
    """Tables and figures go to `describe`, the rest to `recognise`; both add `text`. Descriptions that are null or begin with
    Error are recognised instead."""
    visual = describe(objects.where(F.col("type").isin(*described)))
    failed = F.col("text").isNull() | F.startswith("text", F.lit("Error"))
    rest = objects.where(~F.coalesce(F.col("type").isin(*described), F.lit(False)))
    return visual.where(~failed).unionByName(recognise(rest.unionByName(visual.where(failed).drop("text"))))


def object_entities(objects: DataFrame, recognise: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Layout objects with their entities (text, label, score, start, end) in order; objects without any are left out.

    recognise gets objects with text and gives a row for each entity, with the keys and ent_ord.
    """
    found = recognise(objects.where(F.trim(F.coalesce("OCR", F.lit(""))) != ""))
    held = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ent_ord", "text", "label", "score", "start", "end"))).alias("entities"))
    return objects.join(held, keys)


def analyse_pages(documents: DataFrame, images: DataFrame, cache: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, page_ord, path, objects) of documents (qid, document): pages whose image exists, from the cache where it has them,
    else by detect, which sees each missing page once. Pages without objects have no row."""
    from querent.sources.readers import through_cache

    pages = documents.select("qid", F.posexplode("document").alias("page_ord", "path"))
    # the distinct pages are written: cache and detect don't go over the documents again
    wanted = written(pages.select("path").distinct().join(images.select("path"), "path", "left_semi"), "wanted")
    found = written(through_cache(wanted, cache, detect, "path", "objects").where(F.size("objects") > 0), "objects")
    return pages.join(found, "path").select("qid", "page_ord", "path", "objects")
