"""Names of runs and conditions over a grid of order attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions import runs as N
from querent.plans.registry import Tables, query

GRID = """g AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS tuned, o_orderkey % 2 = 0 AS shots, o_orderkey % 5 < 2 AS ocr, CAST(o_orderkey % 4 AS INT) AS w, CAST(o_orderkey % 6 AS INT) AS n FROM orders),
  m AS (SELECT *, CASE WHEN tuned THEN 'finetuned' WHEN shots THEN 'fewshot' ELSE 'zeroshot' END AS mode FROM g),
  s AS (SELECT *, mode || CASE WHEN ocr THEN '_ocr' ELSE '_noocr' END || CASE WHEN w IN (0, 1) THEN '' ELSE '_w' || w END || CASE WHEN mode = 'fewshot' THEN '_k' || n || '_mixed_random' ELSE '' END AS slug FROM m)"""


def grid(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    few = F.struct((k % 2 == 0).alias("enabled"), (k % 6).cast("int").alias("n_shots"), F.lit("mixed").alias("shot_type"), F.lit("random").alias("selection"))
    own = t.orders.select(k.alias("k"), (k % 3 == 0).alias("tuned"), (k % 2 == 0).alias("shots"), (k % 5 < 2).alias("ocr"), (k % 4).cast("int").alias("w"), few.alias("few"))
    moded = own.withColumn("mode", N.derive_mode(F.col("tuned"), F.col("shots")))
    return moded.withColumn("slug", N.slug(F.col("mode"), F.col("ocr"), F.col("w"), F.col("few")))


@query(f"WITH {GRID} SELECT k, mode, slug FROM s")
def slug(t: Tables) -> DataFrame:
    return grid(t).select("k", "mode", "slug")


@query(f"""WITH {GRID} SELECT k, CASE mode WHEN 'zeroshot' THEN 'Zero-Shot' WHEN 'fewshot' THEN 'Few-Shot' ELSE 'Fine-Tuned (LoRA)' END || ' · ' || CASE WHEN ocr THEN 'OCR' ELSE 'no-OCR' END
  || CASE WHEN w IN (0, 1) THEN '' ELSE ' · w' || w END || CASE WHEN mode = 'fewshot' THEN ' · k' || n || '-random' ELSE '' END AS label FROM s""")
def label(t: Tables) -> DataFrame:
    return grid(t).select("k", N.label(F.col("slug"), F.col("ocr"), F.col("w"), F.col("few")).alias("label"))


@query(f"WITH {GRID} SELECT k, CASE WHEN mode = 'fewshot' THEN n END AS n_shots, CASE WHEN mode = 'fewshot' THEN 'random' END AS selection, mode AS strategy FROM s")
def parse_slug(t: Tables) -> DataFrame:
    p = N.parse_slug(F.col("slug"))
    return grid(t).select("k", p["k"].alias("n_shots"), p["selection"].alias("selection"), N.strategy(F.col("slug")).alias("strategy"))


@query("SELECT event_id, 'eval_' || event_type || '_' || user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events")
def run_id(t: Tables) -> DataFrame:
    return t.events.select("event_id", N.run_id(F.col("event_type"), F.col("user_id"), F.col("ts")).alias("run_id"), N.iso_utc(F.col("ts")).alias("created_at"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS base, 'run/' || page_id || '/' || 'zeroshot' AS leaf FROM pages")
def leaf_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.basename(F.col("url")).alias("base"), N.leaf(F.lit("run"), F.col("page_id").cast("string"), F.lit("zeroshot")).alias("leaf"))
