"""Readers and writers: files made from the driver's tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import runs
from querent.operators import reports
from querent.plans import metric_queries as B
from querent.plans import report_queries as R
from querent.plans.registry import Tables, fixed, query
from querent.sources import readers, sinks
from querent.streaming.incremental import shared_folder


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"


#: Rows of a table that go to one JSON file.
ROWS = 500


def put_blocks(df: DataFrame, block: F.Column, folder: str, values: list[F.Column], json: F.Column) -> None:
    """A text file of one JSON value for each block of rows; `values` are aggregates that the JSON is made of."""
    rows = df.groupBy(block.cast("long").alias("block")).agg(*values).select("block", json.alias("value"))
    rows.repartition("block").write.mode("overwrite").partitionBy("block").text(folder)


def put_questions(t: Tables, path: str) -> None:
    """A question a part, in the order of their numbers."""
    q = F.struct(
        F.col("p_partkey").alias("ord"), F.struct(
            F.col("p_partkey").cast("string").alias("questionId"), F.col("p_name").alias("question"), F.array("p_type").alias("answers"), F.col("p_size").alias("answer_page_idx"),
            F.lit("train").alias("data_split"), F.col("p_brand").alias("docId"), F.array(F.concat("p_brand", F.lit("_1.jpg"))).alias("document")).alias("q"))
    data = F.transform(F.array_sort(F.collect_list(q)), lambda x: x["q"]).alias("data")
    whole = F.to_json(F.struct(F.lit("DUDE").alias("dataset_name"), F.lit("img").alias("base_image_dir"), F.col("data")))
    put_blocks(t.part, F.floor(F.col("p_partkey") / ROWS), path, [data], whole)


@query("SELECT CAST(p_partkey % 500 AS INT) AS ord, CAST(p_partkey AS VARCHAR) AS \"questionId\", p_name AS question, p_type AS answer, p_size AS page, 'DUDE' AS dataset_name, p_brand || '_1.jpg' AS image_path FROM part")
def question_file(t: Tables) -> DataFrame:
    folder = fresh(t.spark)
    put_questions(t, f"{folder}/validation.json")
    out = readers.question_file(t.spark, folder, "val", "DUDE")
    return out.select("ord", "questionId", "question", F.col("answers")[0].alias("answer"), F.col("answer_page_idx").alias("page"), "dataset_name", F.col("image_path")[0].alias("image_path"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"questionId\" FROM part ORDER BY md5('42:' || p_partkey) LIMIT 50 OFFSET 25")
def question_split(t: Tables) -> DataFrame:
    path = f"{fresh(t.spark)}/train.json"
    put_questions(t, path)
    return readers.question_split(t.spark, path, n=50, offset=25).select("questionId")


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"questionId\", p_name AS question, ['DUDE', 'SlideVQA', 'Bounding Docs'][p_partkey % 3 + 1] AS dataset FROM part")
def split_tables(t: Tables) -> DataFrame:
    """Splits of three datasets as Parquet, each under its own name for the validation split."""
    folder, out = fresh(t.spark), None
    for i, (dataset, written, asked) in enumerate((("DUDE", "train", "train"), ("SlideVQA", "val", "val"), ("Bounding Docs", "validation", "val"))):
        rows = t.part.where(F.col("p_partkey") % 3 == i).select(F.col("p_partkey").cast("string").alias("questionId"), F.col("p_name").alias("question"), F.lit(dataset).alias("dataset"))
        rows.write.mode("overwrite").parquet(f"{folder}/{dataset}/{written}")
        one = readers.split_table(t.spark, folder, dataset, asked)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS question FROM part")
def saved_sample(t: Tables) -> DataFrame:
    path = sinks.save_sample(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question")), fresh(t.spark), "DUDE", "val", 10)
    return t.spark.read.schema("id long, question string").json(path)


BOX = "struct<Width:double,Height:double,Left:double,Top:double>"


def boxed(left: F.Column) -> F.Column:
    return F.struct(F.struct(F.lit(1.0).alias("Width"), F.lit(2.0).alias("Height"), left.cast("double").alias("Left"), F.lit(0.5).alias("Top")).alias("BoundingBox"))


# lines without text or box are left out; blocks that are no lines as well
@query("""SELECT p_name AS text, CAST(p_size AS DOUBLE) AS left_, 'line' AS form FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0
  UNION ALL SELECT p_name, CAST(p_size AS DOUBLE), 'block' FROM part WHERE p_size % 2 = 0""")
def recognised_text(t: Tables) -> DataFrame:
    folder = fresh(t.spark)
    line = F.struct(F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("Text"), F.when(F.col("p_size") % 5 != 0, boxed(F.col("p_size"))).alias("Geometry"))
    block_of = F.floor(F.col("p_partkey") / ROWS)
    put_blocks(t.part, block_of, f"{folder}/lines", [F.collect_list(line).alias("LINE")], F.to_json(F.struct("LINE")))
    block = F.struct(F.when(F.col("p_size") % 2 == 0, "LINE").otherwise("WORD").alias("BlockType"), F.col("p_name").alias("Text"), boxed(F.col("p_size")).alias("Geometry"))
    for name, rows, wrap in (("listed", t.part.where("p_size < 25"), lambda x: F.array(x)), ("single", t.part.where("p_size >= 25"), lambda x: x)):
        put_blocks(rows, block_of, f"{folder}/{name}", [F.collect_list(block).alias("Blocks")], F.to_json(wrap(F.struct("Blocks"))))
    lines = readers.ocr(t.spark, f"{folder}/lines", "MPDocVQA").withColumn("form", F.lit("line"))
    for name in ("listed", "single"):
        lines = lines.unionByName(readers.ocr(t.spark, f"{folder}/{name}", "DUDE").withColumn("form", F.lit("block")))
    return lines.select("text", F.col("box.Left").alias("left_"), "form")


@query("SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS obj_id, p_type AS \"ObjectType\", p_name AS \"OCR\" FROM part")
def augmented_objects(t: Tables) -> DataFrame:
    """A dataset with layout as an object of questions: a brand is a question with one page, its parts are the objects."""
    obj = F.struct(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("BBOX"), F.col("p_type").alias("ObjectType"), F.lit("t1").alias("ObjectTypeID"), F.col("p_name").alias("OCR"), F.lit("x").alias("PatchPath"))
    block = F.floor(F.col("p_partkey") / ROWS)
    pages = t.part.groupBy(block.alias("b"), "p_brand").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("k"), obj.alias("v")))).alias("objects"))
    page = F.create_map(F.lit("p1"), F.struct(F.lit("i.jpg").alias("image_path"), F.col("objects").alias("layout_analysis")))
    question = F.struct(F.struct(F.col("p_brand").alias("question")).alias("question_data"), F.struct(page.alias("pages")).alias("layout_analysis"))
    path = fresh(t.spark)
    put_blocks(pages, F.col("b"), path, [F.map_from_entries(F.collect_list(F.struct("p_brand", question.alias("v")))).alias("m")], F.to_json("m"))
    return readers.layout_objects(readers.augmented(t.spark, path)).select("key", "obj_id", "ObjectType", "OCR")


LEAVES = [("run_a", "DUDE", "zeroshot_noocr", True), ("run_a", "DUDE", "fewshot_ocr", False), ("run_b", "SlideVQA", "zeroshot_noocr", True)]


def write_leaves(t: Tables) -> str:
    root = fresh(t.spark)
    for run, dataset, slug, done in LEAVES:
        at = f"{root}/{run}/{dataset}/{slug}"
        sinks.write_manifest(t.spark, f"{at}/manifest.json", {"run_id": run, "dataset": dataset, "config": slug, "n": 3, "counts": sinks.run_counts(3, "corrupted"), "window_size": None})
        if done:
            sinks.put_text(t.spark, f"{at}/predictions.json", "{}")
    sinks.write_manifest(t.spark, f"{root}/latest/manifest.json", {"run_id": "run_b"})
    return root


def values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


@fixed(values([(*x[:3], 3, 3) for x in LEAVES if x[3]], "run_id, dataset, config, n, corrupted"))
def leaves(t: Tables) -> DataFrame:
    return readers.leaves(t.spark, write_leaves(t)).select("run_id", "dataset", "config", "n", F.col("counts")["corrupted"].alias("corrupted"))


@fixed(values([(*x[:3], 3) for x in LEAVES], "run_id, dataset, config, n"))
def manifests(t: Tables) -> DataFrame:
    return readers.manifests(t.spark, write_leaves(t)).select("run_id", "dataset", "config", "n")


@fixed(values([("fewshot_ocr",), ("zeroshot_noocr",)], "slug"))
def discovered_configurations(t: Tables) -> DataFrame:
    found = readers.configurations(t.spark, write_leaves(t))
    return found.where("slug <> 'latest'").select("slug")


@fixed(values([("run_b",)], "run_id"))
def latest_run(t: Tables) -> DataFrame:
    root = fresh(t.spark)
    for run in ("run_a", "run_b"):
        sinks.update_latest(t.spark, root, run)
    return t.spark.read.text(f"{root}/latest").select(F.col("value").alias("run_id"))


@query("SELECT o_orderpriority AS dataset, 'run_a' AS run_id, count(*) AS answers, (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM orders) AS corrupted FROM orders GROUP BY 1")
def saved_run(t: Tables) -> DataFrame:
    """Predictions and the manifest with counts by the sides that were asked."""
    root = fresh(t.spark)
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    manifest = sinks.save_run(t.spark, rows, root, "run_a", "orders", "zeroshot_noocr", {"model_name": "stub"}, "corrupted")
    found = t.spark.read.schema("o_orderkey long, o_orderpriority string").json(f"{root}/run_a/orders/zeroshot_noocr/predictions")
    counts = readers.manifests(t.spark, root).select("run_id", F.col("n").cast("long").alias("n"), F.col("counts")["corrupted"].cast("long").alias("corrupted"), F.col("counts")["clean"].alias("clean"))
    assert manifest["counts"].keys() == {"corrupted"}
    return found.groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("answers")).crossJoin(F.broadcast(counts.where("clean is null").drop("clean")))


@query("SELECT o_orderpriority AS leaf, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 ELSE 0 END AS INT) AS version FROM orders GROUP BY 1")
def saved_predictions(t: Tables) -> DataFrame:
    """A leaf that is written again is replaced; the others stay."""
    folder = fresh(t.spark)
    rows = t.orders.select("o_orderkey", F.lit("r").alias("run_id"), F.lit("d").alias("dataset"), F.col("o_orderpriority").alias("leaf"))
    sinks.save_predictions(rows.withColumn("version", F.lit(0)), folder)
    sinks.save_predictions(rows.where("leaf = '5-LOW'").withColumn("version", F.lit(1)), folder)
    return t.spark.read.parquet(folder).groupBy("leaf").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query(f"SELECT metric, bucket, complexity, n, value FROM ({B.suite_sql()}) WHERE metric <> 'QUR_PL' AND bucket IS NOT NULL")
def saved_metrics(t: Tables) -> DataFrame:
    folder = fresh(t.spark)
    sinks.save_metrics(B.metric_suite(t), folder)
    return t.spark.read.parquet(folder).where("metric <> 'QUR_PL' and bucket is not null").select("metric", "bucket", "complexity", "n", "value")


SUITE_FILES = {"QUR": ("QUR", None, None), "UR_PAGE_inpage": ("UR_PAGE", None, "true"), "QUR_DE": ("QUR_DE", 0, None), "UR_PAGE_QP_complexity_2": ("UR_PAGE_QP", 2, None)}


@query(f"WITH s AS ({B.suite_sql()}) " + " UNION ALL ".join(
    f"SELECT '{name}' AS file, " + ("bucket" if c is not None else f"'{'QUR' if m == 'QUR' else 'UR_inpage'}' || CASE complexity WHEN 0 THEN '' ELSE '_C' || complexity END")
    + f" AS row_, {'coalesce(value, 0)' if c is None else 'value'} AS value FROM s WHERE metric = '{m}'" + (f" AND complexity = {c}" if c is not None else "") + (f" AND bucket = '{b}'" if b else "")
    for name, (m, c, b) in SUITE_FILES.items()))
def saved_suite(t: Tables) -> DataFrame:
    """The suite as named files, of which four are read back."""
    folder, out = fresh(t.spark), None
    paths = {p.rsplit("/", 1)[-1]: p for p in sinks.save_suite(B.metric_suite(t), folder, "stub")}
    for name in SUITE_FILES:
        one = readers.metric_csv(t.spark, paths[name], ["stub"]).select(F.lit(name).alias("file"), F.col("row").alias("row_"), F.col("stub").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_type AS row_, CAST(min(p_size) AS DOUBLE) AS a, CAST(max(p_size) AS DOUBLE) AS b FROM part GROUP BY 1")
def metric_files(t: Tables) -> DataFrame:
    """A metric file with a column a model, of which two are asked; a missing file gives none."""
    path = f"{fresh(t.spark)}/QUR"
    rows = t.part.groupBy("p_type").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), F.lit(0).alias("c"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    assert readers.metric_or_none(t.spark, path + "_gone") is None
    return readers.metric_csv(t.spark, path, ["a", "b"]).withColumnRenamed("row", "row_")


@query("SELECT p_type AS row_, CAST(count(*) AS DOUBLE) AS value, 0.0::DOUBLE AS zero, CAST(count(*) AS DOUBLE) AS same FROM part GROUP BY 1")
def metric_or_none(t: Tables) -> DataFrame:
    path = f"{fresh(t.spark)}/QUR"
    t.part.groupBy("p_type").agg(F.count("*").alias("stub")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    found = readers.metric_or_none(t.spark, path).withColumn("zero", F.col("value")).withColumn("same", F.col("value"))
    return readers.zeroed(readers.zeroed(found, "zero", "results_ocr"), "same", "results").withColumnRenamed("row", "row_")


@query(f"{R.SUMMARY.format(m='QUR')}, 'run_a' AS run_id FROM ({R.QUR_SQL}) UNION ALL {R.SUMMARY.format(m='UR')}, 'run_b' AS run_id FROM ({R.UR_SQL})")
def saved_summaries(t: Tables) -> DataFrame:
    """Summaries of two runs, of which one is written twice and there once."""
    folder = fresh(t.spark)
    both = reports.aggregate_runs(R.summaries(t))
    sinks.save_summary(both, folder)
    sinks.save_summary(both.where("run_id = 'run_a'"), folder)
    return t.spark.read.parquet(folder)


@query(f"""WITH x AS ({R.SUMMARY.format(m='QUR')}, 'run_a' AS run_id FROM ({R.QUR_SQL}) UNION ALL {R.SUMMARY.format(m='UR')}, 'run_b' AS run_id FROM ({R.UR_SQL}))
  SELECT run_id, dataset, config, label, '' AS model, metric, complexity, value FROM x""")
def saved_comparison(t: Tables) -> DataFrame:
    path = fresh(t.spark)
    sinks.save_comparison(reports.aggregate_runs(R.summaries(t)).drop("model"), path)
    return t.spark.read.option("header", True).csv(path).withColumn("value", F.col("value").cast("double")).na.fill({"model": ""})


@query("SELECT string_agg(p_type || ' & ' || printf('%.3f', v) || ' ' || chr(92) || chr(92), chr(10) ORDER BY p_type) AS body FROM (SELECT p_type, CAST(sum(p_size) AS DOUBLE) / 8 AS v FROM part GROUP BY 1)")
def latex_table(t: Tables) -> DataFrame:
    """The body of a table in LaTeX, with eighths, that three digits hold exactly."""
    rows = t.part.groupBy("p_type").agg((F.sum("p_size") / 8).alias("v")).orderBy("p_type")
    body = sinks.latex(rows).split("\n", 2)[2].rsplit("\n", 1)[0]
    return t.spark.createDataFrame([(body,)], "body string")


@query("SELECT o_orderkey AS step, CASE WHEN o_orderkey % 4 = 0 THEN 'evaluation' ELSE 'training' END AS kind, CAST(o_custkey AS DOUBLE) AS value FROM orders WHERE o_orderkey % 4 <> 3")
def training_logs(t: Tables) -> DataFrame:
    """Rows with an evaluation loss are evaluations, whatever else they hold; rows without a loss are dropped."""
    path, k = fresh(t.spark), F.col("o_orderkey") % 4
    loss = F.col("o_custkey").cast("double")
    t.orders.select(F.col("o_orderkey").alias("current_steps"), F.when(k == 0, F.lit(-1.0)).when(k != 3, loss).alias("loss"), F.when(k == 0, loss).alias("eval_loss")).write.mode("overwrite").json(path)
    evaluation, training = readers.training_log(t.spark, path)
    both = evaluation.withColumn("kind", F.lit("evaluation")).unionByName(training.withColumn("kind", F.lit("training")))
    return both.select(F.col("current_steps").alias("step"), "kind", "value")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS pool_ord, n_name AS question, 'items' AS source FROM nation UNION ALL SELECT n_nationkey, n_name, 'fallback' FROM nation")
def few_shot_pools(t: Tables) -> DataFrame:
    """A pool file whose corrupted questions are empty gives its items; without a file the evaluation's questions serve."""
    path = fresh(t.spark)
    record = F.struct("n_nationkey", F.struct(F.col("n_name").alias("original_question"), F.lit(1).alias("complexity")).alias("r"))
    items = F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("items")
    put_blocks(t.nation, F.lit(0), path, [items], F.to_json(F.struct(F.array().cast("array<struct<complexity:int>>").alias("corrupted_questions"), F.col("items"))))
    own = readers.few_shot_pool(t.spark, path, t.nation).select("pool_ord", F.col("original_question").alias("question"), F.lit("items").alias("source"))
    other = readers.few_shot_pool(t.spark, None, t.nation).select(F.col("n_nationkey").alias("pool_ord"), F.col("n_name").alias("question"), F.lit("fallback").alias("source"))
    return own.unionByName(other)


@fixed("SELECT * FROM (VALUES ('given', 'SlideVQA', 2, 100), ('bad', 'DUDE', 3, 100), ('none', 'DUDE', 3, 100)) v(form, dataset, complexity, percentage)")
def configurations(t: Tables) -> DataFrame:
    texts = {"given": '{"dataset": {"name": "SlideVQA"}, "complexity": 2}', "bad": "{not json", "none": None}
    rows = [(form, c["dataset"]["name"], c["complexity"], c["percentage"]) for form, c in ((f, readers.config(x)) for f, x in texts.items())]
    return t.spark.createDataFrame(rows, "form string, dataset string, complexity int, percentage int")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS is_corrupted, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS corrupted, (SELECT count(*) FROM orders) AS labels FROM orders")
def saved_corrupted(t: Tables) -> DataFrame:
    """Corrupted questions as JSON rows with their metadata beside them."""
    path = fresh(t.spark)
    sinks.save_corrupted(t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_corrupted"), F.array("o_orderpriority").alias("entity_type")), path)
    rows = t.spark.read.schema("o_orderkey long, is_corrupted boolean").json(f"{path}/corrupted_questions")
    meta = t.spark.read.schema("total_questions long, corrupted_questions long, entity_types map<string,long>").json(f"{path}/metadata")
    total = F.aggregate(F.map_values("entity_types"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.crossJoin(F.broadcast(meta.select(F.col("total_questions").alias("total"), F.col("corrupted_questions").alias("corrupted"), total.alias("labels"))))


@query("SELECT p_partkey, '<image>' || chr(10) || p_name AS input, p_type AS output, p_brand AS image FROM part")
def saved_examples(t: Tables) -> DataFrame:
    from querent.operators import sft

    path = fresh(t.spark)
    made = t.part.select("p_partkey", sft.example("Answer.", F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("e")).select("p_partkey", "e.*")
    sinks.save_examples(made, path)
    out = t.spark.read.schema("p_partkey long, instruction string, input string, output string, images array<string>").json(path)
    return out.where("instruction = 'Answer.'").select("p_partkey", "input", "output", F.col("images")[0].alias("image"))


@fixed("SELECT * FROM (VALUES ('base', 16, 32, 3.0::DOUBLE, 222)) v(base_model, lora_rank, lora_alpha, epochs, steps)")
def finetune_manifests(t: Tables) -> DataFrame:
    """The adapter's values win over the settings'; missing files are nothing."""
    path = f"{fresh(t.spark)}/run.json"
    sinks.write_manifest(t.spark, path, sinks.finetune_manifest({"base_model_name_or_path": "base", "r": 16}, {"lora_rank": 8, "lora_alpha": 32}, {"epoch": 3.0}, {"log_history": [{"step": 222}, "odd"]}))
    return t.spark.read.schema("base_model string, lora_rank int, lora_alpha int, epochs double, steps int").option("multiLine", True).json(path)


@fixed("SELECT * FROM (VALUES ('unknown', false)) v(git_commit, git_dirty)")
def git_state_unknown(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([runs.git_state("/nowhere")], "git_commit string, git_dirty boolean")


@query("SELECT l_orderkey AS qid, l_linenumber AS win, bool_or(l_returnflag = 'R') AS is_unable FROM lineitem GROUP BY ALL")
def record_answers(t: Tables) -> DataFrame:
    """Records with their windows' answers as JSON files, read by their full schema; records in the order of the questions."""
    from querent.operators import verify

    path = fresh(t.spark)
    w = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("win")).agg(F.max(F.col("l_returnflag") == "R").alias("u"))
    answer = F.struct(F.array(F.col("win").cast("string")).alias("pages"), F.lit("?").alias("answer"), F.when(F.col("u"), "Unable to determine").otherwise("x").alias("answer_converted"))
    per = w.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("win", answer.alias("a")))), lambda x: x["a"]).alias("answers"))
    result = F.struct(F.array(F.struct(F.col("answers").alias("answer_corrupted"))).alias("vqa_results"))
    record = F.struct("k", F.struct(F.lit(True).alias("is_corrupted"), F.lit(1).alias("complexity"), F.col("k").cast("string").alias("original_question"), result.alias("verification_result")).alias("r"))
    put_blocks(per, F.floor(F.col("k") / ROWS), path, [F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("corrupted_questions")], F.to_json(F.struct("corrupted_questions")))
    found = verify.valid_results(readers.records(t.spark, path))
    out = verify.window_answers(found.withColumn("key", F.col("original_question").cast("long")).drop("qid").withColumnRenamed("key", "qid"))
    return out.select("qid", F.col("pages")[0].cast("int").alias("win"), "is_unable")
