"""Entity enrichment: a global map of originals, positions of entities in patches, and missing labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_key(text):
    return F.lower(F.trim(text))


def global_entity_map(originals: DataFrame, order: list[str], attributes: list[str], text: str = "text") -> DataFrame:
    """(key, attributes): of all original entities with the same text, whatever case and blanks, the last by `order` wins."""
    return (
        originals.groupBy(entity_key(F.col(text)).alias("key")).agg(F.max_by(F.struct(text, *attributes), F.struct(*order)).alias("m"))
        .select("key", *(F.col(f"m.{c}").alias(c) for c in [text, *attributes]))
    )


def overwrite(entities: DataFrame, known: DataFrame, attributes: list[str], text: str = "text") -> DataFrame:
    """entities whose text is in the map take its spelling and attributes; others stay."""
    k = known.select("key", *(F.col(c).alias(f"_{c}") for c in [text, *attributes]))
    out = entities.withColumn("key", entity_key(F.col(text))).join(k, "key", "left")
    found = F.col(f"_{text}").isNotNull()
    for c in [text, *attributes]:
        out = out.withColumn(c, F.when(found, F.col(f"_{c}")).otherwise(F.col(c)) if c in entities.columns else F.col(f"_{c}"))
    return out.drop("key", *(f"_{c}" for c in [text, *attributes]))


def positions(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """(qid, ord, positions): where each entity's text is among the patches of its question.

    patches (qid, page_id, page_ord, obj_ord, ent_ord, text, ...). If the entity's page has patches the search is
    limited to it; without a match there all pages are searched. Positions are in page, object, entity order.
    One join on question and text serves both searches.
    """
    p = patches.select("qid", entity_key(F.col("text")).alias("key"), F.struct("page_ord", "obj_ord", "ent_ord", F.col("page_id").alias("on_page"), F.col("text").alias("entity_text")).alias("at"))
    met = entities.withColumn("key", entity_key(F.col("text"))).join(p, ["qid", "key"], "left")
    own = F.col("at.on_page") == F.col("page_id")
    found = met.groupBy("qid", "ord").agg(
        F.array_sort(F.collect_list(F.when(own, F.col("at")))).alias("here"), F.array_sort(F.collect_list("at")).alias("anywhere"))
    return found.select("qid", "ord", F.when(F.size("here") > 0, F.col("here")).otherwise(F.col("anywhere")).alias("positions"))


def label_backfill(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """entities with missing labels filled by the first patch of the question with the same text."""
    first = patches.groupBy("qid", entity_key(F.col("text")).alias("key")).agg(F.min_by("label", F.struct("page_ord", "obj_ord", "ent_ord")).alias("_label"))
    out = entities.withColumn("key", entity_key(F.col("text"))).join(first, ["qid", "key"], "left")
    return out.withColumn("label", F.coalesce("label", "_label")).drop("key", "_label")


def question_entities(listed: DataFrame, known: DataFrame, originals: DataFrame, corrupted: DataFrame) -> DataFrame:
    """(qid, ord, text, label, source): each listed entity from the global map, else the question's originals, else its
    corrupted entities, else without attributes."""
    def keyed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.withColumn("key", entity_key(F.col("text"))).groupBy(*keys, "key").agg(F.min(F.struct("label", "text")).alias(name))

    out = listed.withColumn("key", entity_key(F.col("text")))
    out = out.join(keyed(known, [], "g"), "key", "left").join(keyed(originals, ["qid"], "o"), ["qid", "key"], "left").join(keyed(corrupted, ["qid"], "c"), ["qid", "key"], "left")
    hit = F.coalesce("g", "o", "c")
    source = F.when(F.col("g").isNotNull(), "global").when(F.col("o").isNotNull(), "original").when(F.col("c").isNotNull(), "corrupted").otherwise("none")
    return out.select("qid", "ord", F.coalesce(hit["text"], F.col("text")).alias("text"), hit["label"].alias("label"), source.alias("source"))


def listed_entities(text: Column) -> Column:
    """Entities given as one text, divided at commas: array<struct<ord, text>>, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(text, ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(i.alias("ord"), x.alias("text")))


def question_entities_of_any_form(questions: DataFrame, known: DataFrame, originals: DataFrame, corrupted: DataFrame) -> DataFrame:
    """(qid, ord, text, label, source) for questions (qid, listed array<struct<ord, text>>, written string): lists are looked up as
    by question_entities(); a text, divided at commas, in the global map only; a question with neither takes its originals
    (qid, ord, text, label) that aren't blank."""
    lists = questions.where("listed is not null").select("qid", F.explode("listed").alias("e")).select("qid", "e.ord", "e.text")
    nothing = originals.select("qid", "text", "label").limit(0)
    texts = questions.where("listed is null and written is not null").select("qid", F.explode(listed_entities(F.col("written"))).alias("e")).select("qid", "e.ord", "e.text")
    absent = questions.where("listed is null and written is null").select("qid").join(originals.where(F.trim("text") != ""), "qid")
    out = question_entities(lists, known, originals, corrupted).unionByName(question_entities(texts, known, nothing, nothing))
    return out.unionByName(absent.select("qid", "ord", "text", "label", F.lit("original").alias("source")))


def merged_layouts(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, text, bbox): the texts of a page's objects of one type in reading order, and the box around all of them."""
    box = F.col("bbox")
    return objects.groupBy(*keys, "type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(box[1].alias("y"), box[0].alias("x"), F.col("text").alias("t")))), lambda o: o["t"]), " ").alias("text"),
        F.array(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])).alias("bbox"))


def layout_of(layout_type, layout_type_id):
    """The layout type, or its id where that is null or empty."""
    return F.coalesce(F.nullif(layout_type, F.lit("")), layout_type_id)
