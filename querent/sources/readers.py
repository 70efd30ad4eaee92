"""Readers of datasets, recognised text, caches, manifests, metrics and logs. Every reader has an explicit schema."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.model import LAYOUT_OBJECT, RECORD, STANDARD

#: Dataset names that a question file can be loaded for.
DATASETS = ("Bounding Docs", "DUDE", "MPDocVQA", "SlideVQA")
SPLIT_ALIASES = {"val": "validation"}
MANIFEST = (
    "run_id string, dataset string, config string, split string, n int, seed int, model_name string, mode string, ocr_enabled boolean, window_size int, questions string, "
    "few_shot struct<enabled:boolean,n_shots:int,shot_type:string,selection:string>, counts map<string,int>, git_commit string, git_dirty boolean, created_at string, label string"
)
METRICS = "bucket string, value double"
DEFAULT_CONFIG = {"dataset": {"name": "DUDE", "split": "train"}, "complexity": 3, "percentage": 100}


def dataset_file(spark: SparkSession, path: str, schema: str = STANDARD) -> DataFrame:
    """Rows of the `data` array of a multi-line JSON file {dataset_name, base_image_dir, data}, with their position."""
    raw = spark.read.schema(f"dataset_name string, base_image_dir string, data array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
    return raw.select("dataset_name", "base_image_dir", F.posexplode("data").alias("ord", "d")).select("dataset_name", "base_image_dir", "ord", "d.*")


def _struct(ddl: str) -> str:
    """A struct body from a DDL column list: only the outer name and type are divided by a colon."""
    out, depth, name_next, word = [], 0, True, ""
    for ch in ddl:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == " " and depth == 0 and name_next and word:
            out.append(":")
            name_next, word = False, ""
        elif ch == "," and depth == 0:
            out.append(",")
            name_next, word = True, ""
        elif ch != " " or depth:
            out.append(ch)
            word += ch
    return "".join(out)


def question_file(spark: SparkSession, folder: str, split: str, name: str) -> DataFrame:
    """<folder>/<split>.json of a known dataset, with image_path for document."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    return dataset_file(spark, f"{folder}/{SPLIT_ALIASES.get(split, split)}.json").withColumn("image_path", F.col("document"))


def split_table(spark: SparkSession, folder: str, dataset: str, split: str) -> DataFrame:
    """A split of a dataset that is held as Parquet in <folder>/<dataset>/<split>: val means validation for Bounding Docs.

    The image columns of a hub's files are bytes; they are read only if they are selected.
    """
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(DATASETS)}")
    return spark.read.parquet(f"{folder}/{dataset}/{SPLIT_ALIASES.get(split, split) if dataset == 'Bounding Docs' else split}")


def question_split(spark: SparkSession, path: str, id_col: str = "questionId", shuffle: bool = True, n: int | None = None, offset: int = 0) -> DataFrame:
    """Questions of a dataset file, in the order of a seeded hash or as they stand; the n from an offset on, if given."""
    from querent.operators.sampling import sample_range

    whole = dataset_file(spark, path)
    if n is None:
        return whole
    return sample_range(whole, id_col, n, offset) if shuffle else whole.where((F.col("ord") >= offset) & (F.col("ord") < offset + n))


def configurations(spark: SparkSession, root: str, payload: str = "manifest.json") -> DataFrame:
    """(slug, ord): the folders below root that hold the payload, by the name of the folder, first seen first (by path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", payload).load(root).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("slug"), "path").groupBy("slug").agg(F.min("path").alias("ord"))


def records(spark: SparkSession, path: str, key: str = "corrupted_questions") -> DataFrame:
    """Corrupted questions of a JSON file {key: [record]}, with qid from their position. Values of a wrong type are null."""
    raw = spark.read.schema(f"{key} array<struct<{_struct(RECORD)}>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode(key).alias("qid", "r")).select(F.col("qid").cast("long").alias("qid"), "r.*")


def augmented(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of questions as rows: its keys become questionId."""
    text = spark.read.text(path, wholetext=True)
    kind = f"map<string,struct<question_data:struct<{_struct(STANDARD)}>,layout_analysis:struct<pages:map<string,struct<image_path:string,layout_analysis:map<string,{LAYOUT_OBJECT}>>>>>>"
    return text.select(F.explode(F.from_json("value", kind)).alias("key", "v")).select(F.col("key"), "v.question_data.*", "v.layout_analysis")


def layout_objects(df: DataFrame, layout: str = "layout_analysis") -> DataFrame:
    """A row for each layout object of each page, with ordinals; everything else of df stays."""
    pages = df.select("*", F.posexplode(F.map_entries(f"{layout}.pages")).alias("page_ord", "_p"))
    rest = [c for c in df.columns if c != layout]
    objects = pages.select(*rest, "page_ord", F.col("_p.key").alias("page_id"), F.posexplode(F.map_entries("_p.value.layout_analysis")).alias("obj_ord", "_o"))
    return objects.select(*rest, "page_ord", "page_id", "obj_ord", F.col("_o.key").alias("obj_id"), "_o.value.*")


def line_ocr(spark: SparkSession, path) -> DataFrame:
    """(file, ord, text, box) of files {LINE: [{Text, Geometry: {BoundingBox}}]}; lines without either are left out."""
    box = "struct<Width:double,Height:double,Left:double,Top:double>"
    raw = spark.read.schema(f"LINE array<struct<Text:string,Geometry:struct<BoundingBox:{box}>>>").option("multiLine", True).json(path)
    out = raw.select(F.input_file_name().alias("file"), F.posexplode("LINE").alias("ord", "x"))
    return out.select("file", "ord", F.col("x.Text").alias("text"), F.col("x.Geometry.BoundingBox").alias("box")).where("text is not null and box is not null")


def block_ocr(spark: SparkSession, path) -> DataFrame:
    """(file, ord, text, box) of files {Blocks: [...]} or [{Blocks: [...]}], of which the first counts; only blocks of lines."""
    box = "struct<Width:double,Height:double,Left:double,Top:double>"
    one = f"struct<Blocks:array<struct<BlockType:string,Text:string,Geometry:struct<BoundingBox:{box}>>>>"
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    blocks = F.coalesce(F.get(F.from_json("value", f"array<{one}>"), F.lit(0))["Blocks"], F.from_json("value", one)["Blocks"])
    out = text.select("file", F.posexplode(blocks).alias("ord", "x")).where("x.BlockType = 'LINE'")
    return out.select("file", "ord", F.col("x.Text").alias("text"), F.col("x.Geometry.BoundingBox").alias("box"))


OCR_READERS: dict[str, Callable[[SparkSession, object], DataFrame]] = {"MPDocVQA": line_ocr, "DUDE": block_ocr}


def ocr(spark: SparkSession, paths: str | list[str], dataset: str) -> DataFrame:
    if dataset not in OCR_READERS:
        raise ValueError(f"no recognised text for {dataset!r}")
    return OCR_READERS[dataset](spark, [paths] if isinstance(paths, str) else list(paths))


BOX = "struct<Width:double,Height:double,Left:double,Top:double>"
#: What a file of each kind holds, and where its lines are: their array, and the fields of a line that counts.
OCR_FORMS = {
    "MPDocVQA": (f"struct<LINE:array<struct<Text:string,Geometry:struct<BoundingBox:{BOX}>>>,bad_:string>", "LINE", None),
    "DUDE": (f"struct<Blocks:array<struct<BlockType:string,Text:string,Geometry:struct<BoundingBox:{BOX}>>>,bad_:string>", "Blocks", "LINE"),
}


def ocr_or_error(spark: SparkSession, paths: str | list[str], dataset: str) -> DataFrame:
    """(file, ord, text, box, error): the lines of ocr(), and one row with an error, and nothing else, for each file that
    can't be read as recognised text of this kind or that isn't there.

    One bad file among many is told and the others are read. Files are read by Spark's reader, so that they may lie in
    any store, several to a task. Only names that are given one by one can be told as missing.
    """
    if dataset not in OCR_FORMS:
        raise ValueError(f"no recognised text for {dataset!r}")
    form, lines, kind = OCR_FORMS[dataset]
    gone: list[tuple[str, str]] = []
    there: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        if found is None or not len(found):
            gone.append((path, "no such file"))
            continue
        there.append(path)
        gone += [(str(x.getPath()), "empty file") for x in found if x.isFile() and x.getLen() == 0]  # which Spark's readers pass over
    missing = spark.createDataFrame(gone, "file string, error string")
    empty = missing.select("file", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(BOX).alias("box"), "error")
    if not there:
        return empty
    raw = spark.read.text(there, wholetext=True).select(F.input_file_name().alias("file"), "value")
    options = {"columnNameOfCorruptRecord": "bad_"}
    listed = F.startswith(F.ltrim(F.regexp_replace("value", r"^\s+", "")), F.lit("[")) if kind else F.lit(False)
    one = F.when(listed, F.get(F.from_json("value", f"array<{form}>", options), F.lit(0))).otherwise(F.from_json("value", form, options))
    read = raw.withColumn("r", one).withColumn("error", F.when(F.col("r").isNull() | F.col("r.bad_").isNotNull(), "no JSON of this kind").when(F.col(f"r.{lines}").isNull(), f"no {lines}"))
    line = read.select("file", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col(f"r.{lines}"))).alias("ord", "x"))
    good = F.col("error").isNotNull() | (F.col("x.Text").isNotNull() & F.col("x.Geometry.BoundingBox").isNotNull())
    good = good if kind is None else F.col("error").isNotNull() | (F.col("x.BlockType") == kind)
    return line.where(good).select("file", "ord", F.col("x.Text").alias("text"), F.col("x.Geometry.BoundingBox").alias("box"), "error").unionByName(empty)


def pages_of_documents(documents: DataFrame, files: DataFrame, separator: str = "_", strict: bool = True) -> DataFrame:
    """Files (…, file) of each document (doc), by the part of the file's name before the last separator and number.

    strict joins on that stem, an equi-join. Otherwise a document also gets files of which its id is only a prefix; then
    files are expanded to all prefixes that are as long as some id, so it stays an equi-join as well. Ids are not empty.
    """
    if strict:
        stem = F.substring_index(F.col("file"), separator, 1) if separator == "/" else F.regexp_extract("file", rf"^(.*)\{separator}\d+\.\w+$", 1)
        return files.withColumn("doc", stem).join(documents.distinct(), "doc")
    lengths = documents.select(F.length("doc").alias("_n")).distinct()
    prefixes = files.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.length("file"), F.lit(1)))))
    own = prefixes.join(lengths, "_n", "left_semi").withColumn("doc", F.left("file", F.col("_n"))).drop("_n")
    return own.join(documents.distinct(), "doc")


def page_number(file: Column) -> Column:
    """The number at the end of a file's name, to sort pages by."""
    return F.regexp_extract(file, r"_(\d+)\.\w+$", 1).try_cast("int")


def through_cache(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str, value: str) -> DataFrame:
    """(key, value) from the cache where it has one, else computed; compute sees only keys that are missing."""
    have = wanted.select(key).distinct().join(cache.where(F.col(value).isNotNull()), key).select(key, value)
    missing = wanted.select(key).distinct().join(have, key, "left_anti")
    return have.unionByName(compute(missing).select(key, value))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests below root with their folder, without those in or below `latest`."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/manifest.json$", "")
    return raw.withColumn("leaf", folder).where(~F.contains(F.concat("leaf", F.lit("/")), F.lit("/latest/")))


def leaves(spark: SparkSession, root: str, payload: str = "predictions.json") -> DataFrame:
    """Manifests of folders that also hold the payload, in the order of the folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", payload).load(root).select(F.regexp_replace("path", f"/{payload}$", "").alias("leaf"))
    strip = F.regexp_replace("leaf", "^file:/+", "/")
    return manifests(spark, root).withColumn("leaf", strip).join(files.withColumn("leaf", strip).distinct(), "leaf", "left_semi").orderBy("leaf")


def metric_csv(spark: SparkSession, path: str, models: list[str] | None = None, rows: list[str] | None = None) -> DataFrame:
    """A metric file (label column first, then a column for each model) as (row, models…); a missing model or row fails."""
    raw = spark.read.option("header", True).csv(path)
    index, *have = raw.columns
    wanted = models or have
    if missing := [m for m in wanted if m not in have]:
        raise KeyError(f"no column {missing}")
    out = raw.select(F.col(index).alias("row"), *(F.col(f"`{m}`").cast("double").alias(m) for m in wanted))
    if rows is None:
        return out
    found = {r["row"] for r in out.select("row").where(F.col("row").isin(rows)).distinct().collect()}
    if missing := [r for r in rows if r not in found]:
        raise KeyError(f"no row {missing}")
    return out.where(F.col("row").isin(rows))


def metric_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A one-model metric file as (row, value), or None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    out = metric_csv(spark, path)
    return out.withColumnRenamed(out.columns[1], "value")


def zeroed(df: DataFrame, model: str, folder: str) -> DataFrame:
    """A model's values set to zero in conditions with recognised text, whose folders hold `ocr`."""
    return df.withColumn(model, F.lit(0.0)) if "ocr" in folder else df


def training_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(evaluation, training) rows (current_steps, value) of a JSON-lines log; a row with both losses is an evaluation."""
    raw = spark.read.schema("current_steps long, loss double, eval_loss double").json(path)
    evaluation = raw.where("eval_loss is not null").select("current_steps", F.col("eval_loss").alias("value"))
    return evaluation, raw.where("eval_loss is null and loss is not null").select("current_steps", F.col("loss").alias("value"))


def few_shot_pool(spark: SparkSession, path: str | None, fallback: DataFrame) -> DataFrame:
    """The pool file's corrupted_questions, or items if those are empty; without a file the evaluation's own questions."""
    if path is None:
        return fallback
    raw = spark.read.schema(f"corrupted_questions array<struct<{_struct(RECORD)}>>, items array<struct<{_struct(RECORD)}>>").option("multiLine", True).json(path)
    chosen = F.when(F.size("corrupted_questions") > 0, F.col("corrupted_questions")).otherwise(F.col("items"))
    return raw.select(F.posexplode(chosen).alias("pool_ord", "r")).select("pool_ord", "r.*")


def config(text: str | None) -> dict:
    """A configuration from JSON text over the defaults; bad or missing text gives the defaults. The dataset needs a name."""
    try:
        given = json.loads(text) if text else {}
    except ValueError:
        given = {}
    out = {**DEFAULT_CONFIG, **given} if isinstance(given, dict) else dict(DEFAULT_CONFIG)
    if not isinstance(out.get("dataset"), dict) or not out["dataset"].get("name"):
        raise ValueError("dataset.name is missing")
    return out


def image_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) of PNG files (path, content) from their headers, without decoding them."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.where(F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A").select("path", number(17).alias("width"), number(21).alias("height"))


def encoded(files: DataFrame) -> DataFrame:
    """(path, base64) of binary files, in one line each: Spark breaks those of more than 76 characters."""
    return files.select("path", F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")).alias("base64"))
