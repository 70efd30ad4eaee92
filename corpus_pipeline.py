"""Documents to packed training sequences: quality rules, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import queries
from querent.llm.common import discard, new_path, temporary

#: Pieces of text that a worker remembers while packing: fewer than when packing alone, as the executors' memory
#: also holds what the stages before left; and bytes of texts that it gets at once.
CACHE_PIECES, BATCH_BYTES = 60_000, 2 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; the trees are fitted on the labels beside the table.

    Null, empty and short texts go; repeated rows are judged alike; further columns stay, whatever their names; an
    empty table gives an empty one.
    """
    from querent.llm.quality_rules import fit_rules, keep_good

    return keep_good(docs, fit_rules(docs, queries.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: fingerprints within two bits, or
    a similarity of 0.8 of five-word shingles.

    Texts without words are near-duplicates of each other; rows that share an id stay or go together, those without
    one stay; further columns stay; an empty table gives an empty one.
    """
    from querent.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and counts their characters anew.

    Null texts stay null, with null characters; all rows stay; names that begin with _querent_ are taken; an empty table
    gives an empty one.
    """
    from querent.llm.secrets import redact

    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and kinds of text have their target weights.

    Null sources and languages are a value of their own; rows of one id are drawn alike, and those without one too; a
    table without any words is drawn at one probability; names that begin with _mix_ are taken; an empty table gives
    an empty one.
    """
    from querent.llm.mixing import sample

    return sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences; one row per piece.

    Null and empty texts are their end id alone; repeated rows and rows without an id are packed like others; other
    columns aren't read; an empty table gives no rows.
    """
    from querent.llm.packing import pack

    packed = pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), end_id=1, cache_pieces=CACHE_PIECES)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # read when the result is; others set theirs
    return packed


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the trees, nor the fingerprints' hash, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result but the last is written to the shared folder and read again. What a
    stage wrote on the way, and what the stage before it gave, is deleted once its result is there."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        path = new_path(spark, name)
        with temporary():
            stage(spark, before, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        docs.querent_path = path
        if hasattr(before, "querent_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
