"""Global row numbers without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querent.streaming.incremental import written


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with each row's number, from 0, in the order of some columns, and of a hash of all of them where those are equal.

    Rows are dealt by ranges of the order and written, numbered in each range, and what earlier ranges hold is added,
    of which only one number a range meets in one place.
    """
    tie = "_tie"
    dealt = df.withColumn(tie, F.xxhash64(F.to_json(F.struct(*df.columns)))).repartitionByRange(*order, tie).withColumn("_part", F.spark_partition_id())
    table = written(dealt, "numbered")
    sizes = table.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each range
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order, tie)) - 1
    return table.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + own).select(*df.columns, into)
