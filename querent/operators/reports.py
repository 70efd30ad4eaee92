"""Report frames over the long metric table (run, dataset, model, strategy, metric, bucket, complexity, value, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_COLUMNS = ("dataset", "config", "label", "model", "metric", "complexity", "value")
#: Weights of the density buckets, from the lowest.
DENSITY_WEIGHTS = {"<15": 1.0, "15-25": 0.16, ">25": 0.336}
#: Page counts left out of the binned table.
OUTLIER_PAGES = (5, 6, 17, 20)
PAGE_BINS = ("<4pg", "4pg-8pg", ">8pg")


def summary(found: DataFrame, metric: str, **constants: str) -> DataFrame:
    """Metric rows in the long summary layout; the bucket, if any, is part of the metric's name."""
    name = F.concat(F.lit(metric + "["), F.col("bucket"), F.lit("]")) if "bucket" in found.columns else F.lit(metric)
    level = F.when(F.col("complexity") == 0, "overall").otherwise(F.concat(F.lit("C"), F.col("complexity").cast("string")))
    return found.select(*(F.lit(v).alias(k) for k, v in constants.items()), name.alias("metric"), level.alias("complexity"), "n", "value")


def aggregate_runs(runs: dict[str, DataFrame], datasets: list[str] | None = None) -> DataFrame:
    """All runs' summaries with their run id, in the order of run ids; an empty list of datasets is no filter."""
    out = None
    for run in sorted(runs):
        one = runs[run].withColumn("run_id", F.lit(run))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.where(F.col("dataset").isin(*datasets)) if datasets else out


def pivoted(rows: DataFrame, keys: list[str], column: str, values: list, value: str = "value") -> DataFrame:
    """Mean values with a column for each of the given values; naming them saves a pass over the rows."""
    return rows.groupBy(*keys).pivot(column, values).agg(F.avg(value))


def page_bin(pages: Column) -> Column:
    """Right-closed bins of page counts; null outside."""
    return F.when((pages > 0) & (pages <= 4), PAGE_BINS[0]).when((pages > 4) & (pages <= 8), PAGE_BINS[1]).when((pages > 8) & (pages <= 100), PAGE_BINS[2])


def binned_pages(rows: DataFrame, outliers: tuple[int, ...] = OUTLIER_PAGES, weighted: bool = False) -> DataFrame:
    """Mean rate of each page bin over (bucket, n, hits, value) by page count; every bin is there. weighted: by questions."""
    used = rows.where(~F.col("bucket").cast("int").isin(*outliers)).select(page_bin(F.col("bucket").cast("int")).alias("bin"), "n", "hits", "value").where("bin is not null")
    mean = F.sum("hits") / F.sum("n") if weighted else F.avg("value")
    frame = rows.sparkSession.createDataFrame([(b,) for b in PAGE_BINS], "bin string")
    return frame.join(used.groupBy("bin").agg(mean.alias("value")), "bin", "left")


def weighted_density(rows: DataFrame) -> DataFrame:
    out = F.lit(None).cast("double")
    for bucket, weight in DENSITY_WEIGHTS.items():
        out = F.when(F.col("bucket") == bucket, F.col("value") * weight).otherwise(out)
    return rows.withColumn("weighted", out)


def delta(rows: DataFrame, keys: list[str], before: str = "zeroshot", after: str = "finetuned") -> DataFrame:
    """after less before for each key; null unless both are there."""
    p = rows.groupBy(*keys).agg(F.max(F.when(F.col("strategy") == before, F.col("value"))).alias("before"), F.max(F.when(F.col("strategy") == after, F.col("value"))).alias("after"))
    return p.withColumn("delta", F.col("after") - F.col("before"))


def balanced_refusal(qur: Column, frr: Column) -> Column:
    return (qur + 1 - frr) / 2


def headroom_gain(before: Column, after: Column) -> Column:
    """Share of the room above `before` that `after` gains; null without room."""
    room = 1 - before
    return (after - before) / F.when(room > 0, room)


def macro_headroom(rows: DataFrame, keys: list[str], before: str = "zeroshot", after: str = "finetuned") -> DataFrame:
    """(keys, before, after, delta, gain): means over the datasets that have both values, their difference, and the share of the room
    above the first that it takes. rows (keys, dataset, strategy, value)."""
    both = delta(rows, [*keys, "dataset"], before, after).where("delta is not null")
    means = both.groupBy(*keys).agg(F.avg("before").alias("before"), F.avg("after").alias("after"))
    return means.withColumn("delta", F.col("after") - F.col("before")).withColumn("gain", headroom_gain(F.col("before"), F.col("after")))


def model_means(rows: DataFrame, strategy: str = "finetuned") -> DataFrame:
    """(model, frr, qur): means over the rows (model, strategy, frr, qur) of a strategy that have both."""
    own = rows.where((F.col("strategy") == strategy) & F.col("frr").isNotNull() & F.col("qur").isNotNull())
    return own.groupBy("model").agg(F.avg("frr").alias("frr"), F.avg("qur").alias("qur"))


def wide_complexities(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, name_C1, name_C2, name_C3) of rows (keys, complexity, value)."""
    level = lambda c: F.max(F.when(F.col("complexity") == c, F.col("value")))
    return rows.groupBy(*keys).agg(level(0).alias(name), *(level(c).alias(f"{name}_C{c}") for c in (1, 2, 3)))


def sweep_frame(rows: DataFrame, slug_col: str = "config") -> DataFrame:
    """One row for each dataset and configuration of a sweep: k, selection and strategy from its slug, QUR overall and by complexity,
    QUR_C3 without the 0 that stands for no data; in the order of k."""
    from querent.functions.runs import parse_slug, strategy

    wide = wide_complexities(rows, ["dataset", slug_col], "QUR").withColumn("QUR_C3", sentinel(F.col("QUR_C3")))
    slug = parse_slug(F.col(slug_col))
    out = wide.withColumns({"k": slug["k"], "selection": slug["selection"], "strategy": strategy(F.col(slug_col))})
    return out.orderBy("dataset", *configuration_order(F.col(slug_col), F.col("k")))


def tuned_frame(qur: DataFrame, frr: DataFrame) -> DataFrame:
    """(dataset, QUR…, FRR…) for datasets that have both; without questions of complexity 3 (a QUR_C3 of 0) both sides of it are null."""
    q, f = wide_complexities(qur, ["dataset"], "QUR"), wide_complexities(frr, ["dataset"], "FRR")
    has = F.coalesce(F.col("QUR_C3"), F.lit(0.0)) != 0
    out = q.join(f, "dataset")
    return out.withColumn("FRR_C3", F.when(has, F.col("FRR_C3"))).withColumn("QUR_C3", F.when(has, F.col("QUR_C3")))


#: Layout types of the table on pages with the entity.
IN_PAGE_TYPES = ("title", "plain text", "figure", "table", "abandon")


def summary_table(suite: DataFrame, side: str = "QUR") -> DataFrame:
    """(part, row, value) of the summary of QUR (AccD) or UR (AccP) from the rows of metric_suite(), in the order of part and row.

    QUR: overall and by complexity, density buckets with their weights, bins of page counts (plain means, without the
    outliers), macro entities. UR: overall, visual objects on the page, in-page and out-of-page, macro entities.
    Rates without cases are 0, as in the written files; an empty bin is null.
    """
    known = suite.withColumn("value", F.coalesce("value", F.lit(0.0)))
    level = F.when(F.col("complexity") == 0, side).otherwise(F.concat(F.lit(f"{side}_C"), F.col("complexity").cast("string")))
    own = lambda metric: known.where((F.col("metric") == metric) & (F.col("complexity") == 0))
    row = lambda part, df, name, value: df.select(F.lit(part).alias("part"), name.alias("row"), value.alias("value"))
    bucket, value = F.col("bucket"), F.col("value")
    if side == "QUR":
        parts = [row(1, known.where("metric = 'QUR'"), level, value), row(2, weighted_density(own("QUR_DED")), bucket, F.col("weighted")), row(3, binned_pages(own("QUR_PL")), F.col("bin"), value)]
    else:
        flag = F.when(bucket == "true", "UR_inpage").otherwise("UR_outpage")
        parts = [row(1, own("UR"), level, value), row(2, own("UR_PAGE_DED"), bucket, value), row(3, own("UR_PAGE"), flag, value)]
    parts.append(row(4, own(f"{side}_NLPE"), bucket, value))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_page_table(suite: DataFrame, metric: str = "UR_PAGE_DE") -> DataFrame:
    """(bucket, value) overall of UR_PAGE_QP, or of UR_PAGE_DE for the layout types of the table."""
    out = suite.where((F.col("metric") == metric) & (F.col("complexity") == 0)).select("bucket", F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.where(F.col("bucket").isin(*IN_PAGE_TYPES)) if metric == "UR_PAGE_DE" else out


def macro_average(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Plain mean over datasets, nulls left out."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("value"))


def in_datasets(rows: DataFrame, element: str, least: int = 2) -> DataFrame:
    """Rows whose element occurs in at least `least` datasets."""
    often = rows.groupBy(element).agg(F.countDistinct("dataset").alias("_d")).where(F.col("_d") >= least).select(element)
    return rows.join(often, element, "left_semi")


def sentinel(value: Column) -> Column:
    """Null instead of the 0.0 that stands for no data."""
    return F.nullif(value, F.lit(0.0))


def complexity_stack(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(row, place, value): bucket_C1 to bucket_C3, bucket after bucket."""
    value = F.col("value")
    for bucket, w in (weights or {}).items():
        value = F.when(F.col("bucket") == bucket, F.col("value") * w).otherwise(value)
    return rows.where("complexity > 0").select(F.concat_ws("_C", "bucket", F.col("complexity").cast("string")).alias("row"), F.struct("bucket", "complexity").alias("place"), value.alias("value"))


def joined_conditions(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Two conditions' values side by side."""
    x, y = (df.select(*keys, F.col("value").alias(f"value{s}")) for df, s in zip((a, b), suffixes))
    return x.join(y, keys, "full_outer")


def with_frr(qur: DataFrame, frr: DataFrame, keys: list[str]) -> DataFrame:
    """QUR rows with FRR where there is one."""
    return qur.withColumnRenamed("value", "qur").join(frr.select(*keys, F.col("value").alias("frr")), keys, "left")


def zero_filled(rows: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each model, with 0 where it has no value."""
    return models.join(rows, "model", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def first_slug(configs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct slugs with their first place, and the first slug of each key."""
    return configs.groupBy(*keys).agg(F.min_by("slug", "ord").alias("slug"), F.min("ord").alias("ord"))


def configuration_order(slug: Column, k: Column) -> list[Column]:
    """Baselines first, then by the number of examples."""
    return [F.when(k.isNull(), 0).otherwise(1), k.asc_nulls_first(), slug]


def masked(rows: DataFrame, dataset: str, complexity: int) -> DataFrame:
    """Values of one dataset and complexity taken out."""
    hit = (F.col("dataset") == dataset) & (F.col("complexity") == complexity)
    return rows.withColumn("value", F.when(~hit, F.col("value")))


def radar_vectors(rows: DataFrame) -> DataFrame:
    """(model, vector): values in the order of slice and bucket."""
    return rows.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "bucket", "value"))), lambda x: x["value"]).alias("vector"))


def positive(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value") > 0)


def by_mean(rows: DataFrame, element: str) -> DataFrame:
    """(dataset, element, mean, place): elements of each dataset from the lowest mean up."""
    from pyspark.sql import Window as W

    means = rows.groupBy("dataset", element).agg(F.avg("value").alias("mean"))
    return means.withColumn("place", F.row_number().over(W.partitionBy("dataset").orderBy("mean", element)))


def with_manifest(rows: DataFrame, manifests: DataFrame, keys: list[str], default: str = "model") -> DataFrame:
    """Rows with the model's name from their manifest, or a default."""
    return rows.join(manifests.select(*keys, "model_name"), keys, "left").withColumn("model_name", F.coalesce("model_name", F.lit(default)))
