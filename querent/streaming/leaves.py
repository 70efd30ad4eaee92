"""Leaves of result folders as a checkpointed stream of files: finished ones aren't read again, late ones are taken up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row of a predictions file: one element of its JSON array.
PREDICTION = "questionId string, question string, predicted_answer string, page int"


def follow_leaves(spark: SparkSession, root: str, out: str, steps: Callable[[DataFrame], DataFrame], schema: str = PREDICTION, payload: str = "predictions.json") -> DataFrame:
    """All rows that `steps` made of the payload files below root, with their leaf; files that an earlier call took aren't
    read again.

    Each call works off the files that are new since the last one, in one micro-batch, and ends. steps gets rows
    (schema, leaf, ord) and gives rows with a leaf. A micro-batch writes to a folder of its number, so one that is
    run again after a failure takes its own place. A file that is no JSON of that kind gives rows of nulls in all of
    its columns but leaf and ord, see bad_leaves(). The checkpoint lies beside the results.
    """
    raw = spark.readStream.schema("value string").format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", payload).load(root)
    leaf = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), f"/{payload}$", ""), "^file:/+", "/")
    rows = F.from_json("value", f"array<struct<{as_fields(schema)}>>")
    one = raw.select(leaf.alias("leaf"), F.posexplode_outer(rows).alias("ord", "r")).select("leaf", "ord", "r.*")
    where = f"{out}/rows"

    def step(batch: DataFrame, number: int) -> None:
        steps(batch).write.mode("overwrite").parquet(f"{where}/batch={number}")

    one.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kind = steps(spark.createDataFrame([], f"leaf string, ord int, {schema}")).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(where)


def as_fields(schema: str) -> str:
    """name kind, … as the fields of a struct type."""
    return ",".join(":".join(x.strip().split(" ", 1)) for x in schema.split(","))


def bad_leaves(rows: DataFrame) -> DataFrame:
    """(leaf) of files that couldn't be read as predictions, or that held none."""
    return rows.where("ord is null").select("leaf").distinct()
