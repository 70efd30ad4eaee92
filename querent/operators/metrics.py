"""Refusal metrics: QUR and FRR by question, UR by window answer, and their slices.

Inputs are flat tables: questions (qid, complexity), answers (qid, is_unable, ...), slices (qid, bucket).
Every result has a row for each bucket and complexity, with complexity 0 for all questions; complexities
other than 1, 2 and 3 count there only. value is hits / n, null where n is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.model import COMPLEXITIES, LAYOUT_TYPES, MACRO_ENTITIES, QUADRANTS, UNABLE, VISUAL_TYPES

#: Shares of visual elements at which the second and third bucket begin.
DENSITY_LIMITS = (0.15, 0.25)
DENSITY_BUCKETS = ("<15", "15-25", ">25")
PAGE_VISUALS = ("0", "1", ">1")


def is_unable(converted: Column) -> Column:
    """Whether a canonical answer refuses: equality after lower-casing, false where missing."""
    return F.coalesce(F.lower(converted), F.lit("")) == UNABLE


def answer_stats(answers: DataFrame) -> DataFrame:
    """(qid, n_answers, n_unable)."""
    return answers.groupBy("qid").agg(F.count("*").alias("n_answers"), F.count_if("is_unable").alias("n_unable"))


def refused(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions with hit: whether there are answers and all of them are unable."""
    stats = answer_stats(answers)
    hit = (F.coalesce("n_answers", F.lit(0)) > 0) & (F.col("n_answers") == F.col("n_unable"))
    return questions.join(stats, "qid", "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("n_answers", "n_unable")


def rates(rows: DataFrame, bucket: str | None = None, buckets: tuple[str, ...] | None = None) -> DataFrame:
    """Counts and rates of `hit` over rows (complexity, hit and maybe a bucket column), overall and by complexity.

    One pass with grouping sets. buckets: those that are always there, with zero counts where empty.
    """
    by = [bucket] if bucket else []
    sets = [by, [*by, "complexity"]]
    found = (
        rows.groupingSets(sets, *by, "complexity")
        .agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.grouping("complexity").alias("all_"))
        .withColumn("complexity", F.when(F.col("all_") == 1, 0).otherwise(F.col("complexity")).cast("int"))
        .where((F.col("all_") == 1) | F.col("complexity").isin(*COMPLEXITIES)).drop("all_")
    )
    if bucket is None:
        found = with_skeleton(found, None, None)
    elif buckets is not None:
        found = with_skeleton(found, bucket, buckets)
    return found.withColumn("value", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def with_skeleton(found: DataFrame, bucket: str | None, buckets: tuple[str, ...] | None) -> DataFrame:
    """A row for each fixed bucket and complexity, zero where nothing was counted; other buckets stay."""
    spark = found.sparkSession
    levels = (0, *COMPLEXITIES)
    if bucket is None:
        frame, keys = spark.createDataFrame([(c,) for c in levels], "complexity int"), ["complexity"]
    else:
        frame = spark.createDataFrame([(b, c) for b in buckets for c in levels], f"{bucket} string, complexity int")
        keys = [bucket, "complexity"]
    zeros = frame.withColumn("n", F.lit(0).cast("long")).withColumn("hits", F.lit(0).cast("long"))
    return found.select(*keys, "n", "hits").unionByName(zeros).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def qur(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of questions all of whose answers are unable (of the clean side: FRR)."""
    return rates(refused(questions, answers))


def qur_by(questions: DataFrame, answers: DataFrame, slices: DataFrame, bucket: str = "bucket", buckets: tuple[str, ...] | None = None) -> DataFrame:
    """QUR over (qid, bucket) rows: a question counts once for each of its slice rows."""
    return rates(refused(questions, answers).join(slices.select("qid", bucket), "qid"), bucket, buckets)


def ur(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of window answers that are unable."""
    return rates(answers.join(questions, "qid").select("complexity", F.col("is_unable").alias("hit")))


def ur_by(questions: DataFrame, answers: DataFrame, slices: DataFrame, bucket: str = "bucket", buckets: tuple[str, ...] | None = None) -> DataFrame:
    """UR over answers times slice rows. Both are counted by question before they are multiplied, so no pairs are made."""
    stats = answer_stats(answers)
    held = slices.groupBy("qid", bucket).agg(F.count("*").alias("times"))
    rows = questions.join(stats, "qid").join(held, "qid")
    return weighted_rates(rows, F.col("times") * F.col("n_answers"), F.col("times") * F.col("n_unable"), bucket, buckets)


def weighted_rates(rows: DataFrame, n: Column, hits: Column, bucket: str, buckets: tuple[str, ...] | None = None) -> DataFrame:
    """rates() where a row stands for n cases of which hits are hits."""
    found = (
        rows.groupingSets([[bucket], [bucket, "complexity"]], bucket, "complexity")
        .agg(F.sum(n).cast("long").alias("n"), F.sum(hits).cast("long").alias("hits"), F.grouping("complexity").alias("all_"))
        .withColumn("complexity", F.when(F.col("all_") == 1, 0).otherwise(F.col("complexity")).cast("int"))
        .where((F.col("all_") == 1) | F.col("complexity").isin(*COMPLEXITIES)).drop("all_")
    )
    if buckets is not None:
        found = with_skeleton(found, bucket, buckets)
    return found.withColumn("value", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def unique_entities(entities: DataFrame) -> DataFrame:
    """(qid, text, bucket): each distinct text of a question once, with the object type of its first occurrence."""
    return entities.groupBy("qid", "text").agg(F.min_by("object_type", "ord").alias("bucket"))


def quadrant(center_x: Column, center_y: Column, mean_width: Column, mean_height: Column) -> Column:
    """Quadrant of a centre on a page of mean size; a centre on a middle line belongs to the right or bottom."""
    left, top = center_x < mean_width / 2, center_y < mean_height / 2
    names = dict(zip(QUADRANTS, (left & top, ~left & top, left & ~top, ~left & ~top)))
    out = F.lit(None).cast("string")
    for name, here in names.items():
        out = F.when(here, F.lit(name)).otherwise(out)
    return out


def page_count_slices(answers: DataFrame) -> DataFrame:
    """(qid, bucket): the number of distinct pages over all of a question's answers (answers: qid, page)."""
    return answers.groupBy("qid").agg(F.countDistinct("page").cast("string").alias("bucket"))


def density(visual: Column, text: Column) -> Column:
    """Bucket of a document's share of visual elements."""
    share = visual / (visual + F.greatest(text, F.lit(1)))
    return F.when(share < DENSITY_LIMITS[0], DENSITY_BUCKETS[0]).when(share < DENSITY_LIMITS[1], DENSITY_BUCKETS[1]).otherwise(DENSITY_BUCKETS[2])


def density_slices(objects: DataFrame) -> DataFrame:
    """(qid, bucket) from layout objects (qid, layout_type)."""
    visual = F.col("layout_type").isin(*VISUAL_TYPES)
    return objects.groupBy("qid").agg(density(F.count_if(visual), F.count_if(~visual)).alias("bucket"))


def in_page(answers: DataFrame, patches: DataFrame, corrupted: DataFrame) -> DataFrame:
    """answers with in_page: whether a corrupted entity's text (case-sensitive) is on one of the answer's pages.

    answers (qid, win, page, ...) has a row for each page of a window; patches (qid, page, text, ...).
    """
    wanted = patches.join(corrupted.select("qid", "text").distinct(), ["qid", "text"], "left_semi").select("qid", "page").distinct()
    hits = answers.join(wanted, ["qid", "page"], "left_semi").select("qid", "win").distinct().withColumn("in_page", F.lit(True))
    return answers.drop("page").distinct().join(hits, ["qid", "win"], "left").withColumn("in_page", F.coalesce("in_page", F.lit(False)))


def page_visuals(count: Column) -> Column:
    """Bucket of the number of visual objects on an answer's pages."""
    return F.when(count == 0, PAGE_VISUALS[0]).when(count == 1, PAGE_VISUALS[1]).otherwise(PAGE_VISUALS[2])


def held_objects(patches: DataFrame, corrupted: DataFrame) -> DataFrame:
    """(qid, held): the objects (page, obj, object_type, quadrant) of each question that hold a corrupted entity's text,
    case-sensitive. patches (qid, page, obj, text, object_type, quadrant) has a row for each entity of an object."""
    wanted = patches.join(corrupted.select("qid", "text").distinct(), ["qid", "text"], "left_semi")
    return wanted.groupBy("qid").agg(F.collect_set(F.struct("page", "obj", "object_type", "quadrant")).alias("held"))


def marks(window: Column, held: Column, visual_pages: Column) -> Column:
    """struct<is_unable, kinds, quadrants, visuals> of a window (pages, is_unable): the distinct types and all the quadrants of
    the held objects on its pages, and how many visual objects (an array of their pages) are there."""
    on_it = lambda page: F.array_contains(window["pages"], page)
    here = F.filter(held, lambda o: on_it(o["page"]))
    return F.struct(
        window["is_unable"].alias("is_unable"), F.array_distinct(F.transform(here, lambda o: o["object_type"])).alias("kinds"),
        F.transform(here, lambda o: o["quadrant"]).alias("quadrants"), F.size(F.filter(visual_pages, on_it)).alias("visuals"))


def marked_windows(windows: DataFrame, patches: DataFrame, corrupted: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, is_unable, kinds, quadrants, visuals) of each window (qid, pages, is_unable), which may have several pages; see marks().

    objects (qid, page, layout_type). A question's objects come to its windows as arrays: nothing is multiplied.
    """
    visual = objects.where(F.col("layout_type").isin(*VISUAL_TYPES)).groupBy("qid").agg(F.collect_list("page").alias("visual_pages"))
    out = windows.join(held_objects(patches, corrupted), "qid", "left").join(visual, "qid", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select("qid", marks(F.struct("pages", "is_unable"), none("held"), none("visual_pages")).alias("m")).select("qid", "m.*")


def ur_marked(questions: DataFrame, marked: DataFrame, metric: str) -> DataFrame:
    """UR_PAGE, UR_PAGE_DE, UR_PAGE_QP or UR_PAGE_DED of marked_windows()."""
    bucket = {"UR_PAGE": (F.size("kinds") > 0).cast("string"), "UR_PAGE_DE": F.explode("kinds"), "UR_PAGE_QP": F.explode("quadrants"), "UR_PAGE_DED": page_visuals(F.col("visuals"))}[metric]
    return rates(marked.select("qid", F.col("is_unable").alias("hit"), bucket.alias("bucket")).join(questions, "qid"), "bucket", SUITE[metric])


#: Metrics of the suite in order, with their fixed buckets; None: no buckets; (): those that occur.
SUITE = {
    "QUR": None, "QUR_DE": LAYOUT_TYPES, "QUR_NLPE": tuple(MACRO_ENTITIES), "QUR_QP": QUADRANTS, "QUR_PL": (), "QUR_DED": DENSITY_BUCKETS,
    "UR": None, "UR_DE": LAYOUT_TYPES, "UR_NLPE": tuple(MACRO_ENTITIES), "UR_PAGE": ("false", "true"), "UR_PAGE_QP": QUADRANTS, "UR_PAGE_DE": LAYOUT_TYPES, "UR_PAGE_DED": PAGE_VISUALS,
}
#: Fixed buckets by metric.
BUCKETS = {
    "qur_de": LAYOUT_TYPES, "qur_qp": QUADRANTS, "qur_nlpe": tuple(MACRO_ENTITIES), "qur_ded": DENSITY_BUCKETS,
    "ur_page_ded": PAGE_VISUALS, "ur_page": ("false", "true"),
}


def metric_suite(questions: DataFrame, windows: DataFrame, entities: DataFrame, patches: DataFrame, objects: DataFrame) -> DataFrame:
    """(metric, bucket, complexity, n, hits, value) for all metrics of SUITE in one pass; bucket is null for QUR and UR.

    windows (qid, pages, is_unable), entities (qid, ord, text, object_type, macro, quadrant) that are corrupted, patches and
    objects as for marked_windows(). Each table is brought to one row a question, the rows are joined on it, and
    suite_counts() makes all slices of a question inside its row.
    """
    visual = F.col("layout_type").isin(*VISUAL_TYPES)
    w = windows.groupBy("qid").agg(F.collect_list(F.struct("pages", "is_unable")).alias("w"))
    e = entities.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "object_type", "macro", "quadrant"))).alias("e"))
    o = objects.groupBy("qid").agg(F.count_if(visual).alias("visual"), F.count_if(~visual).alias("other"), F.collect_list(F.when(visual, F.col("page"))).alias("visual_pages"))
    rows = questions.join(w, "qid", "left").join(e, "qid", "left").join(o, "qid", "left").join(held_objects(patches, entities), "qid", "left")
    return whole_suite(suite_counts(rows))


def suite_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric, bucket, complexity, n, hits) of what there is, over questions (by, complexity, w, e, visual, other, visual_pages,
    held) that have all in one row, see metric_suite(); nulls stand for none. Slices are summed up by complexity, and
    only those sums once more over all."""
    kinds = {c: rows.schema[c].dataType for c in ("w", "e", "visual_pages", "held")}
    rows = rows.select(*by, "complexity", F.coalesce("visual", F.lit(0)).alias("visual"), F.coalesce("other", F.lit(0)).alias("other"), *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in kinds.items()))
    rows = rows.withColumn("m", F.transform("w", lambda x: marks(x, F.col("held"), F.col("visual_pages"))))
    rows = rows.withColumn("firsts", F.filter("e", lambda x, i: ~F.exists(F.slice("e", 1, i), lambda y: y["text"] == x["text"])))
    n, unable = F.size("w").cast("long"), F.size(F.filter("w", lambda x: x["is_unable"])).cast("long")
    one, all_unable = F.lit(1).cast("long"), ((n > 0) & (n == unable)).cast("long")
    slice_ = lambda metric, bucket, count, hits: F.struct(F.lit(metric).alias("metric"), bucket.cast("string").alias("bucket"), count.alias("n"), hits.alias("hits"))
    hit = lambda x: x["is_unable"].cast("long")
    nothing = F.lit(None)
    made = [
        F.array(slice_("QUR", nothing, one, all_unable), slice_("UR", nothing, n, unable), slice_("QUR_DED", density(F.col("visual"), F.col("other")), one, all_unable),
                slice_("QUR_PL", F.size(F.array_distinct(F.flatten(F.transform("w", lambda x: x["pages"])))), one, all_unable)),
        F.transform("m", lambda x: slice_("UR_PAGE", (F.size(x["kinds"]) > 0).cast("string"), one, hit(x))),
        F.transform("m", lambda x: slice_("UR_PAGE_DED", page_visuals(x["visuals"]), one, hit(x))),
        F.flatten(F.transform("m", lambda x: F.transform(x["kinds"], lambda k: slice_("UR_PAGE_DE", k, one, hit(x))))),
        F.flatten(F.transform("m", lambda x: F.transform(x["quadrants"], lambda q: slice_("UR_PAGE_QP", q, one, hit(x))))),
    ]

    def both(name: str, of: str, field: str) -> list[Column]:
        return [F.transform(of, lambda x: slice_(f"QUR_{name}", x[field], one, all_unable)), F.transform(of, lambda x: slice_(f"UR_{name}", x[field], n, unable))]

    made += both("DE", "firsts", "object_type") + both("NLPE", "e", "macro")
    made.append(F.transform("e", lambda x: slice_("QUR_QP", x["quadrant"], one, all_unable)))
    slices = rows.select(*by, "complexity", F.explode(F.concat(*made)).alias("s")).select(*by, "complexity", "s.*")
    parts = slices.groupBy(*by, "metric", "bucket", "complexity").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    found = (
        parts.groupingSets([[*by, "metric", "bucket"], [*by, "metric", "bucket", "complexity"]], *by, "metric", "bucket", "complexity")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.grouping("complexity").alias("all_"))
        .withColumn("complexity", F.when(F.col("all_") == 1, 0).otherwise(F.col("complexity")).cast("int"))
        .where((F.col("all_") == 1) | F.col("complexity").isin(*COMPLEXITIES)).drop("all_"))
    return found.select(*by, "metric", "bucket", "complexity", "n", "hits")


def whole_suite(counts: DataFrame) -> DataFrame:
    """suite_counts() with a row for each fixed bucket and complexity, and the rates."""
    zeros = [(m, b, c) for m, bs in SUITE.items() for b in ((None,) if bs is None else bs) for c in (0, *COMPLEXITIES)]
    frame = counts.sparkSession.createDataFrame(zeros, "metric string, bucket string, complexity int").select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("hits"))
    whole = counts.select("metric", "bucket", "complexity", "n", "hits").unionByName(frame).groupBy("metric", "bucket", "complexity").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return whole.withColumn("value", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def run_counters(rows: DataFrame) -> DataFrame:
    """One row (processed, success, errors, success_rate) over results with is_error; the rate is null without any."""
    bad = F.coalesce("is_error", F.lit(False))
    return rows.agg(F.count("*").alias("processed"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("errors"), F.try_divide(F.count_if(~bad), F.count("*")).alias("success_rate"))


def answer_accuracy(pairs: DataFrame) -> DataFrame:
    """One row (n, accuracy): share of answers equal to what was expected, blanks at the ends and case aside; null without any."""
    same = F.lower(F.trim("answer")) == F.lower(F.trim("expected"))
    return pairs.agg(F.count("*").alias("n"), F.try_divide(F.count_if(same), F.count("*")).alias("accuracy"))


def mean_page_size(pages: DataFrame) -> DataFrame:
    """(qid, mean_width, mean_height) over a question's distinct pages (qid, path, width, height)."""
    return pages.dropDuplicates(["qid", "path"]).groupBy("qid").agg((F.sum("width") / F.count("*")).alias("mean_width"), (F.sum("height") / F.count("*")).alias("mean_height"))


def enabled_labels(flags: dict[str, bool]) -> list[str]:
    """Labels of the macro entities that are switched on, in their fixed order."""
    return [label for macro, labels in MACRO_ENTITIES.items() if flags.get(macro, False) for label in labels]
