"""Selection of pages for a judge, and its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def adjacent_pages(pages: DataFrame, natural_order: bool = False) -> DataFrame:
    """Pages (qid, page_id, hit) that are hit or stand beside one. Pages are ordered by name, so p10 comes before p2,
    unless natural_order goes by the number in the name."""
    order = [F.regexp_extract("page_id", r"(\d+)(?!.*\d)", 1).cast("long"), F.col("page_id")] if natural_order else [F.col("page_id")]
    w = W.partitionBy("qid").orderBy(*order)
    near = F.col("hit") | F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False))
    return pages.withColumn("near", near).where("near").drop("near")


def any_page_answers(judged: DataFrame) -> DataFrame:
    """(qid, verification_result, image_path) of judged pages (qid, page_ord, image_path, answerable).

    The first answerable page decides; without one the verdict is False with the last page's image.
    """
    yes = F.coalesce("answerable", F.lit(False))
    return judged.groupBy("qid").agg(
        F.when(F.bool_or(yes), "true").otherwise("False").alias("verification_result"),
        F.coalesce(F.min_by("image_path", F.when(yes, F.col("page_ord"))), F.max_by("image_path", "page_ord")).alias("image_path"))


def only_false(df: DataFrame, column: str = "verification_result") -> DataFrame:
    """Questions that the judge found unanswerable; all columns stay."""
    return df.where(F.lower(F.col(column).cast("string")) == "false")


def valid_results(records: DataFrame) -> DataFrame:
    """Records (RECORD schema) that are corrupted and have model answers."""
    return records.where(F.coalesce("is_corrupted", F.lit(False)) & (F.size("verification_result.vqa_results") > 0))


def window_answers(records: DataFrame, side: str = "corrupted") -> DataFrame:
    """(qid, win, pages, answer, answer_converted, is_unable) of the first result of each record (with a qid)."""
    from querent.operators.metrics import is_unable

    first = F.get("verification_result.vqa_results", F.lit(0))
    out = records.select("qid", F.posexplode(first[f"answer_{side}"]).alias("win", "a"))
    return out.select("qid", "win", "a.pages", "a.answer", "a.answer_converted", is_unable(F.col("a.answer_converted")).alias("is_unable"))


def zip_entities(original, corrupted):
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(original), F.size(corrupted))
    return F.arrays_zip(F.slice(original, 1, n).alias("original"), F.slice(corrupted, 1, n).alias("corrupted"))


def missing_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (qid, path) that no image exists for."""
    return records.join(images.select("path").distinct(), "path", "left_anti")


def skip_without_images(questions: DataFrame, paths: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions none of whose pages (array column) lacks its image, and one row (total, skipped) of how many do."""
    gone = missing_images(questions.select("qid", F.explode(paths).alias("path")), images).select("qid").distinct()
    counted = questions.join(gone.withColumn("_gone", F.lit(True)), "qid", "left").agg(F.count("*").alias("total"), F.count("_gone").alias("skipped"))
    return questions.join(gone, "qid", "left_anti"), counted
