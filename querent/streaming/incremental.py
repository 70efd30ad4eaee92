"""Incremental forms: generation up to an exact number, rate windows, skipping what is done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def calls_in_window(df: DataFrame, time: str, seconds: int, keys: list[str]) -> DataFrame:
    """df with calls: how many rows of the same keys lie within so many seconds before each, itself included."""
    w = W.partitionBy(*keys).orderBy(F.unix_seconds(F.col(time).cast("timestamp"))).rangeBetween(-seconds, 0)
    return df.withColumn("calls", F.count("*").over(w))


def verified_until(source: DataFrame, verify: Callable[[DataFrame], DataFrame], key: str, target: int, folder: str | None = None) -> DataFrame:
    """The first `target` verified rows of a stream of questions, by batch and key.

    Each micro-batch leaves out keys that were processed before, is verified, and is appended with the number of its
    batch; a batch that is run again after a failure overwrites its own files, so nothing counts twice. Keys
    count as processed even if nothing of them was verified. Batches after the target change nothing.
    """
    spark = source.sparkSession
    folder = folder or f"{shared_folder(spark)}/exact-{uuid.uuid4().hex[:12]}"
    kept, seen, counts = f"{folder}/verified", f"{folder}/processed", f"{folder}/counts"
    empty = spark.createDataFrame([], source.schema)
    verify(empty).withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").partitionBy("batch").parquet(kept)
    empty.select(key).withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").partitionBy("batch").parquet(seen)
    kept_schema = verify(empty).withColumn("batch", F.lit(0).cast("long")).schema
    seen_schema = empty.select(key).withColumn("batch", F.lit(0).cast("long")).schema
    numbers = "n long, batch long"
    spark.createDataFrame([(0, -1)], numbers).write.mode("overwrite").partitionBy("batch").parquet(counts)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # a row for each batch says how many were verified; the batches themselves aren't read again
        so_far = session.read.schema(numbers).parquet(counts).where(F.col("batch") < number).agg(F.sum("n")).first()[0] or 0
        if so_far >= target:
            return
        done = session.read.schema(seen_schema).parquet(seen).where(F.col("batch") < number).select(key)
        fresh = batch.join(done, key, "left_anti").dropDuplicates([key])
        at = f"{kept}/batch={number}"
        verify(fresh).write.mode("overwrite").parquet(at)
        fresh.select(key).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        session.read.parquet(at).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    run = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    # whole batches come before the one that reaches the target, and of that one the first by key
    upto = spark.read.schema(numbers).parquet(counts).groupBy("batch").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("batch")))  # a row a batch
    last = upto.where(F.col("upto") >= target).orderBy("batch").first()
    every = spark.read.schema(kept_schema).parquet(kept)
    if last is None:
        return every.drop("batch")
    part = every.where(F.col("batch") == last["batch"]).orderBy(key).limit(target - last["upto"] + last["n"])
    return every.where(F.col("batch") < last["batch"]).unionByName(part).drop("batch")


def shared_folder(spark) -> str:
    """The shared folder of the session; a folder of this machine only where Spark runs on it alone."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not hasattr(spark.sparkContext, "_querent_folder"):
        import tempfile

        spark.sparkContext._querent_folder = "file://" + tempfile.mkdtemp(prefix="querent-")
    return spark.sparkContext._querent_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is worked out once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_new(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have no result yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
