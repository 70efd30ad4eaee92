"""Work by parts with a log of commits: a run that is killed goes on where it stopped, with no result twice or by half.

Keys are dealt to a fixed number of parts by their hash. The results of some parts are written in one job, to a folder of
their own for each attempt; then each part is published by a file of its name in the log, which exactly one attempt
can create. Readers see only attempts that the log names, so what a killed attempt left doesn't count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a new log, and how many of them a job works on.
PARTS, AT_ONCE = 64, 8


class CommitLog:
    """The log in a folder that driver and executors share. parts only counts for a new log: an old one keeps its own."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._create("parts.txt", str(parts))
        self.parts = int(self._read("parts.txt"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, name: str, text: str) -> bool:
        """Write a whole new file; False if there is one of this name. It is written aside and then renamed, which fails where
        there is one, so nobody reads half of it and of several writers one wins."""
        from py4j.protocol import Py4JJavaError

        store, where = self._store(name), self._path(name)
        if store.exists(where):
            return False
        aside = self._path(f"_aside/{uuid.uuid4().hex}")
        out = store.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        store.mkdirs(where.getParent())
        fs = self.spark._jvm.org.apache.hadoop.fs
        strict = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, where, strict)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise
            store.delete(aside, False)
            return False
        return True

    def _read(self, name: str) -> str:
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]

    def part(self, key: Column) -> Column:
        """The part of a key; rows without a key are a part like others."""
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def attempts(self) -> dict[int, str]:
        """The attempt that each finished part was published with."""
        store = self._store("log")
        if not store.exists(self._path("log")):
            return {}
        names = [s.getPath().getName() for s in store.listStatus(self._path("log"))]
        rows = self.spark.read.text(f"{self.folder}/log").collect() if names else []  # one short line a part
        return {r["part"]: r["attempt"] for r in (json.loads(row[0]) for row in rows)}

    def publish(self, attempt: str, parts: list[int]) -> list[int]:
        """Name an attempt as the result of these parts; gives those that no other attempt had published before."""
        return [p for p in parts if self._create(f"log/part-{p:06d}", json.dumps({"part": p, "attempt": attempt}))]

    def write(self, df: DataFrame, parts: list[int], work: Callable[[DataFrame], DataFrame]) -> str:
        """The results of these parts of df (with column _part) as a new attempt, which isn't published yet."""
        attempt = uuid.uuid4().hex
        own = df.where(F.col("_part").isin(parts))
        work(own).write.partitionBy("_part").parquet(f"{self.folder}/data/attempt={attempt}")
        return attempt

    def run(self, df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE) -> list[int]:
        """Work off the parts of df that aren't published, some at a time; gives the parts that this run published.

        work gets rows with the column _part, which it has to keep, and gives any number of rows for each. Parts without
        rows are published as well.
        """
        todo = sorted(set(range(self.parts)) - set(self.attempts()))
        own = df.withColumn("_part", self.part(F.col(key)))
        done: list[int] = []
        for at in range(0, len(todo), at_once):
            parts = todo[at : at + at_once]
            done += self.publish(self.write(own, parts, work), parts)
        return done

    def results(self, schema: str) -> DataFrame:
        """All published rows, of a schema without _part."""
        return self.with_parts(schema).drop("_part")

    def with_parts(self, schema: str) -> DataFrame:
        """All published rows with the part that they belong to."""
        published, store = self.attempts(), self._store("data")
        if not published or not store.exists(self._path("data")):
            return self.spark.createDataFrame([], f"{schema}, _part int")
        raw = self.spark.read.schema(f"{schema}, attempt string, _part int").parquet(f"{self.folder}/data")
        wanted = self.spark.createDataFrame(sorted(published.items()), "_part int, attempt string")  # a row for each part
        return raw.join(F.broadcast(wanted), ["_part", "attempt"], "left_semi").drop("attempt").select(*(c for c in raw.columns if c not in ("_part", "attempt")), "_part")

    def sweep(self) -> int:
        """Delete attempts that no part was published with, after all writers have ended; gives their number."""
        store, kept, n = self._store("data"), set(self.attempts().values()), 0
        if store.exists(self._path("data")):
            for s in store.listStatus(self._path("data")):
                if s.getPath().getName().removeprefix("attempt=") not in kept:
                    store.delete(s.getPath(), True)
                    n += 1
        return n
