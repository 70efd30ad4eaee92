"""Report frames on metric slices; order priorities stand for datasets and order status for strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators import metrics as M
from querent.operators import reports as R
from querent.plans import metric_queries as B
from querent.plans.registry import Tables, query

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STRATEGY = {"P": "fewshot", "O": "zeroshot", "F": "finetuned"}


def cells(t: Tables) -> DataFrame:
    """(dataset, strategy, complexity, n, hits, value)."""
    s = F.when(F.col("o_orderstatus") == "P", "fewshot").when(F.col("o_orderstatus") == "O", "zeroshot").otherwise("finetuned")
    q = t.orders.select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("complexity"), F.col("o_orderpriority").alias("dataset"), s.alias("strategy"))
    r = M.refused(q, B.answers(t))
    return r.groupBy("dataset", "strategy", "complexity").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("value", F.col("hits") / F.col("n"))


CELLS = f"""{B.Q.replace('FROM orders', ", o_orderpriority AS dataset, CASE o_orderstatus WHEN 'P' THEN 'fewshot' WHEN 'O' THEN 'zeroshot' ELSE 'finetuned' END AS strategy FROM orders")}, {B.A},
  s AS (SELECT qid, count(*) AS n_answers, count(*) FILTER (WHERE is_unable) AS n_unable FROM a GROUP BY qid),
  r AS (SELECT q.*, coalesce(n_answers > 0 AND n_answers = n_unable, false) AS hit FROM q LEFT JOIN s USING (qid)),
  k AS (SELECT dataset, strategy, complexity, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS value FROM r GROUP BY ALL)"""
TOTAL = "tot AS (SELECT dataset, strategy, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS value FROM k GROUP BY ALL)"


def totals(t: Tables) -> DataFrame:
    return cells(t).groupBy("dataset", "strategy").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).withColumn("value", F.col("hits") / F.col("n"))


@query(f"WITH {CELLS} SELECT dataset, strategy, complexity, n, hits, value FROM k")
def metric_cells(t: Tables) -> DataFrame:
    return cells(t)


@query(f"""WITH {CELLS}, {TOTAL} SELECT strategy, {', '.join(f"max(value) FILTER (WHERE dataset = '{p}') AS d{p[0]}" for p in PRIORITIES)} FROM tot GROUP BY strategy""")
def pivot_qur(t: Tables) -> DataFrame:
    return R.pivoted(totals(t), ["strategy"], "dataset", list(PRIORITIES)).withColumnsRenamed({p: f"d{p[0]}" for p in PRIORITIES})


@query(f"""WITH {CELLS}, {TOTAL} SELECT dataset, max(value) FILTER (WHERE strategy = 'zeroshot') AS before, max(value) FILTER (WHERE strategy = 'finetuned') AS after,
  max(value) FILTER (WHERE strategy = 'finetuned') - max(value) FILTER (WHERE strategy = 'zeroshot') AS delta FROM tot GROUP BY dataset""")
def delta(t: Tables) -> DataFrame:
    return R.delta(totals(t), ["dataset"])


@query(f"""WITH {CELLS}, {TOTAL}, d AS (SELECT dataset, max(value) FILTER (WHERE strategy = 'zeroshot') AS b, max(value) FILTER (WHERE strategy = 'finetuned') AS a FROM tot GROUP BY dataset)
  SELECT dataset, (a - b) / CASE WHEN 1 - b > 0 THEN 1 - b END AS gain FROM d""")
def headroom(t: Tables) -> DataFrame:
    return R.delta(totals(t), ["dataset"]).select("dataset", R.headroom_gain(F.col("before"), F.col("after")).alias("gain"))


@query(f"""WITH {CELLS}, {TOTAL}, f AS (SELECT dataset, CAST(count(*) FILTER (WHERE strategy = 'fewshot') AS BIGINT) AS x FROM r GROUP BY dataset)
  SELECT a.dataset, (a.value + 1 - b.value) / 2 AS bra FROM tot a JOIN tot b ON a.dataset = b.dataset AND a.strategy = 'finetuned' AND b.strategy = 'zeroshot'""")
def bra(t: Tables) -> DataFrame:
    d = R.delta(totals(t), ["dataset"])
    return d.select("dataset", R.balanced_refusal(F.col("after"), F.col("before")).alias("bra"))


@query("""WITH x AS (SELECT DISTINCT l_partkey AS element, o_orderpriority AS dataset FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)
  SELECT element, dataset FROM x WHERE element IN (SELECT element FROM x GROUP BY element HAVING count(DISTINCT dataset) >= 2)""")
def having_two(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return R.in_datasets(rows.select(F.col("l_partkey").alias("element"), F.col("o_orderpriority").alias("dataset")).distinct(), "element")


PL = B.qur_sql("SELECT qid, CAST(count(DISTINCT page) AS VARCHAR) AS bucket FROM a GROUP BY qid")


@query(f"""WITH pl AS ({PL}), u AS (SELECT CASE WHEN CAST(bucket AS INT) BETWEEN 1 AND 4 THEN '<4pg' WHEN CAST(bucket AS INT) BETWEEN 5 AND 8 THEN '4pg-8pg' WHEN CAST(bucket AS INT) BETWEEN 9 AND 100 THEN '>8pg' END AS bin, value AS rate
  FROM pl WHERE complexity = 0 AND CAST(bucket AS INT) NOT IN (5, 6, 17, 20))
  SELECT b.v AS bin, avg(rate) AS value FROM (VALUES {B.values(R.PAGE_BINS)}) b(v) LEFT JOIN u ON u.bin = b.v GROUP BY b.v""")
def pl_bins(t: Tables) -> DataFrame:
    rows = M.qur_by(B.questions(t), B.answers(t), M.page_count_slices(B.answers(t))).where("complexity = 0")
    return R.binned_pages(rows)


@query(f"""WITH d AS ({B.qur_sql(B.DED, M.DENSITY_BUCKETS)}) SELECT bucket, complexity, value * CASE bucket WHEN '<15' THEN 1.0::DOUBLE WHEN '15-25' THEN 0.16::DOUBLE ELSE 0.336::DOUBLE END AS weighted FROM d""")
def weighted_ded(t: Tables) -> DataFrame:
    rows = M.qur_by(B.questions(t), B.answers(t), M.density_slices(B.entities(t)), buckets=M.DENSITY_BUCKETS)
    return R.weighted_density(rows).select("bucket", "complexity", "weighted")


def summaries(t: Tables) -> dict[str, DataFrame]:
    constants = {"dataset": "orders", "config": "zeroshot_noocr", "label": "Zero-Shot", "model": "stub"}
    return {
        "run_a": R.summary(M.qur(B.questions(t), B.answers(t)), "QUR", **constants),
        "run_b": R.summary(M.ur(B.questions(t), B.answers(t)), "UR", **constants),
    }


SUMMARY = "SELECT 'orders' AS dataset, 'zeroshot_noocr' AS config, 'Zero-Shot' AS label, 'stub' AS model, '{m}' AS metric, CASE WHEN complexity = 0 THEN 'overall' ELSE 'C' || complexity END AS complexity, n, value"
QUR_SQL = f"WITH {B.Q}, {B.A}, {B.R}, rows_ AS (SELECT * FROM r) {B.NO_BUCKET}"
UR_SQL = f"WITH {B.Q}, {B.A}, rows_ AS (SELECT complexity, is_unable AS hit FROM a JOIN q USING (qid)) {B.NO_BUCKET}"


@query(f"{SUMMARY.format(m='QUR')} FROM ({QUR_SQL})")
def summary_long(t: Tables) -> DataFrame:
    return summaries(t)["run_a"]


@query(f"{SUMMARY.format(m='QUR')}, 'run_a' AS run_id FROM ({QUR_SQL}) UNION ALL {SUMMARY.format(m='UR')}, 'run_b' AS run_id FROM ({UR_SQL})")
def comparison(t: Tables) -> DataFrame:
    return R.aggregate_runs(summaries(t))


@query(f"""WITH {CELLS} SELECT dataset || ' ' || strategy || '_C' || complexity AS row_, n, value FROM k""")
def complexity_rows(t: Tables) -> DataFrame:
    rows = cells(t).withColumn("bucket", F.concat_ws(" ", "dataset", "strategy"))
    stacked = R.complexity_stack(rows).join(rows.select(F.concat_ws("_C", "bucket", F.col("complexity").cast("string")).alias("row"), "n"), "row")
    return stacked.select(F.col("row").alias("row_"), "n", "value")


@query(f"""WITH {CELLS}, {TOTAL} SELECT a.dataset, a.value AS qur, b.value AS frr FROM tot a LEFT JOIN tot b ON a.dataset = b.dataset AND b.strategy = 'zeroshot' AND b.hits > 150 WHERE a.strategy = 'finetuned'""")
def qur_with_frr(t: Tables) -> DataFrame:
    own = totals(t)
    return R.with_frr(own.where("strategy = 'finetuned'"), own.where("strategy = 'zeroshot' and hits > 150"), ["dataset"]).select("dataset", "qur", "frr")


@query(f"WITH {CELLS} SELECT dataset, strategy, complexity, CASE WHEN NOT (dataset = '5-LOW' AND complexity = 3) THEN value END AS value FROM k")
def masked_matrix(t: Tables) -> DataFrame:
    return R.masked(cells(t), "5-LOW", 3).select("dataset", "strategy", "complexity", "value")


@query("""WITH x AS (SELECT p_type AS element, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
  SELECT element, CASE WHEN hits > 0 THEN CAST(hits AS DOUBLE) / n END AS value FROM x""")
def sentinel_rates(t: Tables) -> DataFrame:
    own = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("element")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("v"))
    return own.select("element", R.sentinel(F.col("v")).alias("value"))
