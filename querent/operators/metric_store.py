"""Metrics of many runs from counts that are kept for each leaf, so that a further run costs its own rows only.

Counts of disjoint questions add up, and so do those of leaves. A leaf's counts are a version of their own, which
is complete once its success mark is there; readers take each leaf's last complete version, so a leaf is replaced as
a whole or not at all, and a version that a killed run left behind is passed over.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "metric string, bucket string, complexity int, n long, hits long"


class MetricStore:
    """Counts by leaf in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _store(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, store = self._store(path)
        return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []

    def versions(self) -> dict[str, int]:
        """The last complete version of each leaf, by the leaf's quoted name."""
        out = {}
        for leaf in self._names(self.folder):
            done = [int(v) for v in self._names(f"{self.folder}/{leaf}") if v.isdigit() and "_SUCCESS" in self._names(f"{self.folder}/{leaf}/{v}")]
            if done:
                out[leaf] = max(done)
        return out

    def put(self, leaf: str, counts: DataFrame) -> None:
        """Add a leaf's counts (of metric_suite(), or any (metric, bucket, complexity, n, hits)), or put them in place of those
        that it has. Earlier versions go once the new one is complete."""
        name = "leaf-" + quote(leaf, safe="")
        before = [int(v) for v in self._names(f"{self.folder}/{name}") if v.isdigit()]
        new = max(before, default=0) + 1
        kinds = [c.strip().split(" ") for c in COUNTS.split(",")]
        counts.select(*(F.col(c).cast(k).alias(c) for c, k in kinds)).coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(f"{self.folder}/{name}/{new}")  # some hundred rows
        for v in before:
            where, store = self._store(f"{self.folder}/{name}/{v}")
            store.delete(where, True)

    def remove(self, leaf: str) -> None:
        where, store = self._store(f"{self.folder}/leaf-{quote(leaf, safe='')}")
        store.delete(where, True)

    def counts(self) -> DataFrame:
        """All leaves' counts with their leaf."""
        paths = [f"{self.folder}/{leaf}/{v}" for leaf, v in sorted(self.versions().items())]
        if not paths:
            return self.spark.createDataFrame([], f"leaf string, {COUNTS}")
        raw = self.spark.read.schema(COUNTS).parquet(*paths)
        leaf = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"/leaf-([^/]+)/[0-9]+/[^/]+$", 1)  # the path itself is quoted once more
        return raw.select(F.url_decode(leaf).alias("leaf"), "*")

    def combined(self, keep: Column | None = None) -> DataFrame:
        """(metric, bucket, complexity, n, hits, value) over all leaves, or those that `keep` takes (of column leaf)."""
        some = self.counts() if keep is None else self.counts().where(keep)
        whole = some.groupBy("metric", "bucket", "complexity").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        return whole.withColumn("value", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))
