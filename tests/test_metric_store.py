"""Counts of leaves that are added, replaced, removed and left behind half written."""

from pyspark.sql import functions as F

from querent.operators.metric_store import COUNTS, MetricStore


def rows(spark, *items):
    return spark.createDataFrame([("QUR", None, 0, n, hits) for n, hits in items], COUNTS)


def total(df):
    r = df.first()
    return r and (r["n"], r["hits"], r["value"])


def test_leaves_are_added_replaced_and_removed(spark, tmp_path):
    store = MetricStore(spark, f"file://{tmp_path}/metrics")
    assert store.combined().count() == 0
    store.put("DUDE/zero shot+%/a", rows(spark, (3, 1)))
    store.put("b", rows(spark, (5, 2), (1, 0)))
    assert total(store.combined()) == (9, 3, 3 / 9)
    store.put("b", rows(spark, (2, 2)))
    assert total(store.combined()) == (5, 3, 3 / 5)
    assert {r["leaf"] for r in store.counts().collect()} == {"DUDE/zero shot+%/a", "b"}
    assert total(store.combined(F.col("leaf") == "b")) == (2, 2, 1.0)
    store.remove("b")
    assert total(store.combined()) == (3, 1, 1 / 3)


def test_a_half_written_version_is_passed_over(spark, tmp_path):
    store = MetricStore(spark, f"file://{tmp_path}/metrics")
    store.put("a", rows(spark, (3, 1)))
    rows(spark, (100, 100)).write.parquet(f"file://{tmp_path}/metrics/leaf-a/2")
    (tmp_path / "metrics" / "leaf-a" / "2" / "_SUCCESS").unlink()
    assert total(store.combined()) == (3, 1, 1 / 3)
    store.put("a", rows(spark, (4, 0)))
    assert total(store.combined()) == (4, 0, 0.0)


def test_suite_reads_the_lines_once_and_equals_that_of_separate_tables(spark):
    from querent.operators import metrics as M
    from querent.plans import registry

    B, data = registry.metric_queries, "/root/testdata/sf0.001"
    suite = registry.QUERIES["metric_suite"](spark, data)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    assert scans(suite) == 1
    for name in ("summary_qur", "summary_ur", "in_page_tables", "stored_metrics"):
        assert scans(registry.QUERIES[name](spark, data)) == 0, name
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(suite) == rows(M.metric_suite(*B.suite_inputs(registry.Tables(spark, data))))
