"""Writers of samples, predictions, metrics, summaries and manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.operators.reports import SUMMARY_COLUMNS


def save_sample(df: DataFrame, folder: str, dataset: str, split: str, n: int) -> str:
    path = f"{folder}/{dataset}_{split}_{n}/qas/{split}"
    df.write.mode("overwrite").json(path)
    return path


def save_predictions(df: DataFrame, folder: str) -> None:
    """Answers partitioned by run, dataset and leaf; only the partitions written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "dataset", "leaf").parquet(folder)


def run_counts(n: int, questions: str) -> dict[str, int]:
    """A manifest's counts by the sides that were asked: corrupted, clean or both."""
    return {side: n for side in ("corrupted", "clean") if questions in ("both", side)}


def save_run(spark: SparkSession, df: DataFrame, folder: str, run_id: str, dataset: str, leaf: str, manifest: dict, questions: str = "both") -> dict:
    """Predictions of one condition and, beside them, its manifest with run, dataset, configuration, n and counts; returns the manifest."""
    n = df.count()
    whole = {**manifest, "run_id": run_id, "dataset": dataset, "config": leaf, "n": n, "questions": questions, "counts": run_counts(n, questions)}
    at = f"{folder}/{run_id}/{dataset}/{leaf}"
    df.write.mode("overwrite").json(f"{at}/predictions")
    write_manifest(spark, f"{at}/manifest.json", whole)
    return whole


def save_corrupted(df: DataFrame, path: str) -> DataFrame:
    """Corrupted questions as JSON rows, and their metadata beside them: a row (total_questions, corrupted_questions, entity_types)."""
    from querent.operators.sft import corruption_metadata

    df.write.mode("overwrite").json(f"{path}/corrupted_questions")
    found = corruption_metadata(df)
    found.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return found


def save_suite(suite: DataFrame, folder: str, model: str) -> list[str]:
    """All metrics of metric_suite() as named files: <metric>.csv and <metric>_complexity_1 to _3 for those with buckets, one file
    with all complexities for QUR and UR, and UR_PAGE divided into inpage and outpage. Small tables."""
    from querent.operators.metrics import SUITE

    out = []
    cached = suite.persist()
    level = lambda name: F.when(F.col("complexity") == 0, name).otherwise(F.concat(F.lit(f"{name}_C"), F.col("complexity").cast("string")))
    try:
        for metric, buckets in SUITE.items():
            own = cached.where(F.col("metric") == metric)
            parts = [(metric, metric, own)]
            if metric == "UR_PAGE":
                parts = [(f"UR_PAGE_{side}", f"UR_{side}", own.where(F.col("bucket") == flag)) for side, flag in (("inpage", "true"), ("outpage", "false"))]
            elif buckets is not None:
                out += save_metric_csv(own, folder, metric, model)
                continue
            for name, row, rows in parts:
                rows.select(level(row).alias("index"), F.coalesce("value", F.lit(0.0)).alias(model)).orderBy("index").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
                out.append(f"{folder}/{name}")
    finally:
        cached.unpersist()
    return out


def save_metrics(df: DataFrame, folder: str) -> None:
    """One long table of all metrics, partitioned by metric."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric").parquet(folder)


def save_metric_csv(df: DataFrame, folder: str, name: str, model: str) -> list[str]:
    """The rows of a metric (bucket, complexity, value) as name.csv for all questions and name_complexity_1 to _3: small tables."""
    out = []
    for c in range(4):
        path = f"{folder}/{name}" + (f"_complexity_{c}" if c else "")
        one = df.where(F.col("complexity") == c).select(F.col("bucket").alias("index"), F.col("value").alias(model)).orderBy("index")
        one.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        out.append(path)
    return out


def save_summary(df: DataFrame, folder: str) -> None:
    """Summary rows of leaves (with run_id and config): a leaf that is written again is replaced, not repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "config").parquet(folder)


def save_comparison(df: DataFrame, path: str) -> None:
    """Runs' summaries in fixed column order, nulls empty."""
    out = df.select("run_id", *((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in SUMMARY_COLUMNS)).na.fill("")
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latex(df: DataFrame, digits: int = 3, most: int = 10_000) -> str:
    """A report table as LaTeX rows, numbers with fixed digits, in the order of df; one of more than `most` rows is refused."""
    cells = [rounded(F.col(c), digits) if kind == "double" else F.col(c).cast("string") for c, kind in df.dtypes]
    rows = df.select(F.concat_ws(" & ", *(F.coalesce(c, F.lit("")) for c in cells)).alias("r")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a LaTeX table of more than {most} rows")
    body = " \\\\\n".join(r["r"] for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(df.columns)} \\\\\n{body} \\\\\n\\end{{tabular}}"


def rounded(value: Column, digits: int = 3) -> Column:
    """A number as text with fixed digits, for display; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    put_text(spark, path, json.dumps(manifest, indent=2, ensure_ascii=False))


def update_latest(spark: SparkSession, root: str, run_id: str) -> None:
    """A pointer file names the newest run."""
    put_text(spark, f"{root}/latest", run_id)


def save_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sweep_manifest(leaves: DataFrame) -> DataFrame:
    """(run_id, leaves): the sorted distinct leaf names of each run."""
    return leaves.groupBy("run_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))


def finetune_manifest(adapter: dict | None, settings: dict | None, results: dict | None, state: dict | None) -> dict:
    """A training run's record from its files, any of which may be missing; the adapter's values win over the settings."""
    adapter, settings, results, state = adapter or {}, settings or {}, results or {}, state or {}
    pick = lambda a, b: adapter.get(a, settings.get(b))
    history = [h for h in state.get("log_history", []) if isinstance(h, dict)]
    return {
        "base_model": adapter.get("base_model_name_or_path", settings.get("model_name_or_path")),
        "lora_rank": pick("r", "lora_rank"), "lora_alpha": pick("lora_alpha", "lora_alpha"), "lora_dropout": pick("lora_dropout", "lora_dropout"),
        "epochs": results.get("epoch", settings.get("num_train_epochs")), "train_loss": results.get("train_loss"), "eval_loss": results.get("eval_loss"),
        "train_runtime": results.get("train_runtime"), "steps": state.get("global_step", max((h.get("step", 0) for h in history), default=None)),
    }
