"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A table is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing (local tests) is a folder of this machine used.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    set_before = getattr(spark.sparkContext, "_querent_folder", None)
    if set_before is None:
        set_before = "file://" + tempfile.mkdtemp(prefix="querent-")
        spark.sparkContext._querent_folder = set_before
    return set_before


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/querent-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.querent_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def temporary():
    """Within it tables of materialize() are noted, and deleted at its end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        discard(*_SCOPES.pop())


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() gave; nothing that is still to be run may read them."""
    for t in tables:
        remove(t.sparkSession, t.querent_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote into the shared folder."""
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `rows` rows; otherwise as it is, for a shuffled join.

    df should be a materialized or otherwise cheap table, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys with more than one in so many of all rows are hot; there can't be more than this.
HOT_KEYS = 10_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """left with the columns of right, a table with one row a key; null where right has none. Null keys match each other.

    However many rows share a key, no task gets them all: keys with more than one in HOT_KEYS of the rows, which
    are at most HOT_KEYS, are broadcast, and their rows are dealt by a hash of all columns. counts: (keys, copies)
    of left, if known. left is read twice and should be a table. Column order: left's, then right's.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("copies")) if counts is None else counts
    counts = materialize(counts, "counts")
    most = (counts.agg(F.sum("copies")).first()[0] or 0) / HOT_KEYS
    own = [c for c in right.columns if c not in keys]
    named = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *own)
    same = lambda side: [F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in keys]
    often = counts.where(F.col("copies") > most)
    if most < 1 or often.isEmpty():
        return left.join(named, same("_r_"), "left").drop(*(f"_r_{k}" for k in keys))
    hot = named.join(F.broadcast(often), [F.col(f"_r_{k}").eqNullSafe(F.col(k)) for k in keys], "left_semi")
    hot = hot.select(*(F.col(f"_r_{k}").alias(f"_h_{k}") for k in keys), F.struct(F.lit(True).alias("there"), *own).alias("_hot"))
    met = left.join(F.broadcast(hot), same("_h_"), "left").drop(*(f"_h_{k}" for k in keys))
    away = F.when(F.col("_hot").isNotNull(), F.xxhash64(*left.columns)).otherwise(0)
    cold = named.select("*", F.lit(0).cast("long").alias("_r_away")).withColumn("_cold", F.struct(F.lit(True).alias("there"), *own)).drop(*own)
    dealt = met.withColumn("_away", away).join(cold, [*same("_r_"), F.col("_away") == F.col("_r_away")], "left")
    return dealt.select(*left.columns, *(F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in own))


def dealt(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df as a table that is divided by ranges of keys and order, with the number of the range as _part; for running()."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), name)


def running(table: DataFrame, keys: list[str], order: list[F.Column], out: str, value: F.Column | None = None) -> DataFrame:
    """A table of dealt() with `out`, without _part: over the rows before each one among those of its keys, in this
    order, the largest `value`, or their number if there is no value.

    Rows are numbered in each range, and what a key brings along from earlier ranges is added, which concerns at
    most one key a range. So a key of any number of rows is shared out. The order has no ties among a key's rows.
    """
    before = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    of = F.count("*") if value is None else F.max(value)
    ends = table.groupBy("_part").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))
    across = ends.select("_part", F.explode(F.array_distinct(F.array("first", "last"))).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k.*")
    both = table.join(F.broadcast(across), [table[k].eqNullSafe(across[k]) for k in keys], "left_semi")
    parts = both.groupBy("_part", *keys).agg(of.alias("all_"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    brought = parts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_c_{k}") for k in keys), (F.sum("all_") if value is None else F.max("all_")).over(earlier).alias("_brought"))
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys)]
    met = table.withColumn(out, of.over(before)).join(F.broadcast(brought.where("_brought is not null")), same, "left")
    total = F.col(out) + F.coalesce("_brought", F.lit(0)) if value is None else F.coalesce(out, "_brought")
    return met.withColumn(out, total).drop("_part", "_p", "_brought", *(f"_c_{k}" for k in keys))


#: Arrow batches that go to Python workers are bounded in bytes, so that very long texts don't add up, and in rows.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def arrow_batches(spark: SparkSession) -> None:
    """Sets ARROW_BATCHES. Spark reads them when a plan is run, so they are the same for all operators and stay."""
    for name, value in ARROW_BATCHES.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def ascii_lower(column) -> F.Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
