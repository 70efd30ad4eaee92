"""Source datasets in one schema of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.operators.ranges import numbered

COLUMNS = ("questionId", "question", "answers", "answer_page_idx", "data_split", "docId", "document")


def zero_based(page: Column) -> Column:
    """One-based pages as zero-based; what isn't a number, and numbers below one, are the first page."""
    return F.greatest(F.coalesce(page.try_cast("int"), F.lit(1)) - 1, F.lit(0))


def conform(df: DataFrame) -> DataFrame:
    kinds = {"answers": "array<string>", "document": "array<string>", "answer_page_idx": "int"}
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def standardize_located(df: DataFrame, split: str, require_box: bool = True) -> DataFrame:
    """Questions of one split with answers and, if asked for, answer boxes; bbox: struct<page array, left array>."""
    ok = (F.col("data_split") == split) & (F.size("answers") > 0)
    if require_box:
        ok = ok & F.coalesce(F.size("bbox.left") > 0, F.lit(False))
    return conform(df.where(ok).withColumn("answer_page_idx", F.coalesce(F.get("bbox.page", F.lit(0)).cast("int"), F.lit(0))))


def flatten_documents(raw: DataFrame, language: Callable[[Column], Column] | None = None, order: str | None = None, skip: int = 0, most: int | None = None) -> DataFrame:
    """Questions of documents whose `qa` is a JSON text {id: {question, answers: [{value, page}]}}; other texts give none.

    language: a function of the question column; only questions it calls en stay. An answer that is no object is the
    value itself, on the first page. order: a column that documents are ordered by; then only the valid questions from
    number `skip` on come out, `most` of them.
    """
    qa = F.from_json("qa", "map<string,struct<question:string,answers:array<string>>>")
    kept = [c for c in raw.columns if c != "qa"]
    out = raw.select("*", F.posexplode(F.map_entries(qa)).alias("_n", "e")).select(*kept, "_n", F.col("e.key").alias("questionId"), "e.value.question", "e.value.answers")
    if language is not None:
        out = out.where(F.coalesce(language(F.col("question")) == "en", F.lit(False)))
    parts = lambda a: F.from_json(a, "struct<value:string,page:string>")
    fixed = F.transform("answers", lambda a: F.when(F.startswith(F.ltrim(a), F.lit("{")), F.struct(parts(a)["value"].alias("value"), zero_based(parts(a)["page"]).alias("page"))).otherwise(F.struct(a.alias("value"), F.lit(0).alias("page"))))
    out = out.withColumn("answers", fixed)
    if order is not None and (skip or most is not None):
        placed = numbered(out, [order, "_n"], "_at")
        out = placed.where((F.col("_at") >= skip) & (F.col("_at") < skip + most if most is not None else F.lit(True))).drop("_at")
    return out.drop("_n")


def standardize_flattened(df: DataFrame) -> DataFrame:
    """From flatten_documents (with document, data_split, docId): the first answer's page and the answers' values."""
    ok = df.where(F.size("answers") > 0)
    return conform(ok.withColumn("answer_page_idx", F.coalesce(F.get("answers", F.lit(0))["page"], F.lit(0))).withColumn("answers", F.transform("answers", lambda a: a["value"])))


def long_pages(df: DataFrame, prefix: str = "page_") -> DataFrame:
    """Wide page columns page_1 … page_N, in the order of their numbers, as one array without nulls; evidence pages zero-based."""
    wide = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()), key=lambda c: int(c[len(prefix):]))
    out = df.withColumn("document", F.array_compact(F.array(*wide))).drop(*wide)
    return out.withColumn("evidence_pages", F.transform("evidence_pages", lambda p: p - 1)) if "evidence_pages" in df.columns else out


def standardize_slides(df: DataFrame) -> DataFrame:
    """From long_pages (answer: one text): questions with an answer; the page is the first of the evidence."""
    ok = df.where(F.coalesce(F.col("answer"), F.lit("")) != "")
    return conform(ok.withColumn("answers", F.array("answer")).withColumn("answer_page_idx", F.coalesce(F.get("evidence_pages", F.lit(0)).cast("int"), F.lit(0))))


def standardize_paged(df: DataFrame, folder: str) -> DataFrame:
    """Questions with doc_id and page_ids; all columns stay, pages become paths."""
    return df.withColumnRenamed("doc_id", "docId").withColumn("document", F.transform("page_ids", lambda p: F.concat(F.lit(folder.rstrip("/") + "/"), p, F.lit(".jpg"))))
