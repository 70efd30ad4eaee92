"""Training examples for supervised fine-tuning, few-shot turns, and their recaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.operators.ranges import numbered

#: The image placeholder and the refusal sentence around the first corrupted text.
PLACEHOLDER = "<image>\n"
REFUSAL = ("Unable to determine. The term '", "' refers to a corrupted entity not present as a data point in this context.")


def refusal(text: Column) -> Column:
    return F.concat(F.lit(REFUSAL[0]), text, F.lit(REFUSAL[1]))


def example(instruction: str, question: Column, output: Column, image: Column) -> Column:
    return F.struct(
        F.lit(instruction).alias("instruction"), F.concat(F.lit(PLACEHOLDER), question).alias("input"), output.alias("output"), F.array(image).alias("images"))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def refusal_examples(entries: DataFrame, instruction: str) -> DataFrame:
    """From corrupted records with an image, a question and a first corrupted text: one example each."""
    image, text = F.col("verification_result.image_path"), F.get("corrupted_entities", F.lit(0))["text"]
    ok = entries.where(filled(image) & filled(F.col("corrupted_question")) & filled(text))
    return ok.select(example(instruction, F.col("corrupted_question"), refusal(text), image).alias("e")).select("e.*")


def clean_examples(entries: DataFrame, instruction: str) -> DataFrame:
    """From standardised questions with pages: the first answer, on the answer's page or the last if that is beyond."""
    image = F.element_at("document", F.least(F.col("answer_page_idx") + 1, F.size("document")))
    ok = entries.where(F.size("document") > 0)
    return ok.select(example(instruction, F.col("question"), F.get("answers", F.lit(0)), image).alias("e")).select("e.*")


def paired_examples(entries: DataFrame, instruction: str) -> DataFrame:
    """Two examples a record: the refusal of the corrupted question and the answer to the original one."""
    image, text = F.col("verification_result.image_path"), F.get("corrupted_entities", F.lit(0))["text"]
    answer = F.get("original_answer_locations", F.lit(0))["answer"]
    ok = entries.where(filled(image) & filled(F.col("corrupted_question")) & filled(text) & filled(F.col("original_question")) & answer.isNotNull())
    both = F.array(example(instruction, F.col("corrupted_question"), refusal(text), image), example(instruction, F.col("original_question"), answer, image))
    return ok.select(F.explode(both).alias("e")).select("e.*")


def shuffled_union(frames: list[DataFrame], seed: int = 42, place: str = "place") -> DataFrame:
    """All frames by name, with each row's place, from 0, in the order of a hash of the rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"})))
    return numbered(out.withColumn("_k", key), ["_k"], place).drop("_k")


def recap(rows: DataFrame) -> DataFrame:
    """rows (dataset, kind clean or corrupted): counts of both and total by dataset and, with a null dataset, overall; the
    dataset's share of all examples, and the share of clean ones among its own, in percent."""
    found = rows.rollup("dataset").agg(
        F.count_if(F.col("kind") == "clean").alias("clean"), F.count_if(F.col("kind") == "corrupted").alias("corrupted"), F.count("*").alias("total"), F.grouping("dataset").alias("all_"))
    # the total is one of a few rows, so it comes to them by a window over those
    from pyspark.sql import Window as W

    every = F.max(F.when(F.col("all_") == 1, F.col("total"))).over(W.partitionBy())
    return found.select("dataset", "clean", "corrupted", "total", F.try_divide(F.col("total") * 100, every).alias("share"), F.try_divide(F.col("clean") * 100, F.col("clean") + F.col("corrupted")).alias("clean_share"))


def label_histogram(labels: DataFrame) -> DataFrame:
    """(label, n) of (label, times)."""
    return labels.groupBy("label").agg(F.sum("times").cast("long").alias("n"))


def corruption_metadata(records: DataFrame) -> DataFrame:
    """One row (total_questions, corrupted_questions, entity_types): entity_types is a map of how often each label occurs among the
    arrays entity_type. Counted by label before they meet, so only the labels do."""
    labels = records.select(F.explode("entity_type").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    counted = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("entity_types"))
    totals = records.agg(F.count("*").alias("total_questions"), F.count_if(F.coalesce("is_corrupted", F.lit(False))).alias("corrupted_questions"))
    return totals.crossJoin(F.broadcast(counted))


def next_answers(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn right after it."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    out = conversations.withColumn("_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return out.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def few_shot_turns(shots: Column) -> Column:
    """Two turns for each shot (image_paths, question, answer): the question with its images, then the answer."""
    none = F.lit(None).cast("array<string>")
    pair = lambda s: F.array(
        F.struct(F.lit("user").alias("role"), s["image_paths"].alias("image_paths"), s["question"].alias("text")),
        F.struct(F.lit("assistant").alias("role"), none.alias("image_paths"), s["answer"].alias("text")))
    return F.flatten(F.transform(shots, pair))


def truncated(ids: Column, labels: Column, longest: int, end_id: int, masked: int = -100) -> Column:
    """struct<ids, labels> cut to `longest`; where every label left is masked the last one becomes the end id."""
    a, b = F.slice(ids, 1, longest), F.slice(labels, 1, longest)
    all_masked = F.forall(b, lambda x: x == masked)
    fixed = F.when(all_masked & (F.size(b) > 0), F.concat(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), F.array(F.lit(end_id)))).otherwise(b)
    return F.struct(a.alias("ids"), fixed.alias("labels"))
