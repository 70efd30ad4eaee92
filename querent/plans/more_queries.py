"""Selection of examples, forms of enrichment, report frames and model hooks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions import runs, text as X
from querent.model import MACRO_ENTITIES
from querent.operators import corruption as C
from querent.operators import enrich, models, reports, sampling, sft, standardize, verify
from querent.operators import metrics as M
from querent.plans import answer_queries as Q
from querent.plans import corruption_queries as K
from querent.plans import metric_queries as B
from querent.plans import report_queries as R
from querent.plans.registry import Tables, fixed, query
from querent.streaming import incremental

# --- few-shot selection; parts of small size stand for the hand-picked pool

POOL = "pool AS (SELECT o_orderkey AS qid, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)"


@query("""WITH p AS (SELECT p_partkey AS pool_id, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part)
  SELECT o_orderkey AS qid, CAST(n AS INT) AS place, pool_id, 'answerable' AS role FROM orders, p WHERE n <= 3""")
def few_shot_handpicked(t: Tables) -> DataFrame:
    pool = t.part.select(F.col("p_partkey").alias("qid"), F.struct("p_retailprice", "p_partkey").alias("pool_ord"))
    return sampling.select_few_shot(t.orders.select(F.col("o_orderkey").alias("qid")), pool, 3, "handpicked", leave_out=False)


@query("""WITH p AS (SELECT o_orderkey AS pool_id, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS at, count(*) OVER () AS size FROM orders),
  s AS (SELECT o_orderkey AS qid, CAST('0x' || left(md5('43:' || o_orderkey), 12) AS BIGINT) % (SELECT count(*) FROM orders) AS s FROM orders),
  m AS (SELECT s.qid, i.v AS i, p.pool_id FROM s, range(0, 5) i(v), p WHERE p.at = (s.s + i.v) % p.size AND p.pool_id <> s.qid),
  n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i) AS n FROM m), k AS (SELECT *, CASE WHEN n <= 2 THEN 'answerable' ELSE 'unanswerable' END AS role FROM n WHERE n <= 4)
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY md5('42:' || qid || ':' || pool_id), n) AS INT) AS place, pool_id, role FROM k""")
def few_shot_mixed(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderkey").alias("qid")).withColumn("pool_ord", F.col("qid"))
    return sampling.select_few_shot(own, own, 4, "random", "mixed")


# --- samples


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000) ORDER BY md5('42:' || o_orderkey) LIMIT 100 OFFSET 50""")
def sample_different(t: Tables) -> DataFrame:
    used = t.customer.where("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return sampling.sample_different_from(t.orders, used, "o_orderkey", 100, "o_custkey", 50).select("o_orderkey")


@query("SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS place FROM events")
def shuffled_events(t: Tables) -> DataFrame:
    """The order of the shuffled table, at 100 percent as well."""
    whole = sampling.sample_percent(t.events, "event_id", 100)
    return sampling.numbered(whole.select(F.col("event_id").alias("pool_id"), sampling.shuffled("event_id").alias("h")), whole.count()).select(F.col("pool_id").alias("event_id"), (F.col("at") + 1).alias("place"))


# --- datasets

LETTERS = "CASE WHEN event_type IN ('click', 'view') THEN 'en' WHEN event_type = 'error' THEN NULL ELSE 'fr' END"


@query(f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY event_id // 100, event_id) AS n FROM events WHERE {LETTERS} = 'en')
  SELECT CAST(event_id // 100 AS VARCHAR) AS "docId", CAST(event_id AS VARCHAR) AS "questionId", event_type AS question, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE greatest(event_id % 5 - 1, 0) END AS INT) AS page,
  CASE WHEN event_id % 3 = 0 THEN 'plain ' || event_id ELSE 'v' || event_id END AS answer FROM v WHERE n > 100 AND n <= 1100""")
def flatten_english(t: Tables) -> DataFrame:
    """Plain and located answers, only of questions in English, the second hundred on."""
    e, ident = F.col("event_type"), F.col("event_id").cast("string")
    located = F.concat(F.lit('{"value": "v'), ident, F.lit('", "page": '), (F.col("event_id") % 5).cast("string"), F.lit(', "location": [1, 2]}'))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"plain '), ident, F.lit('"'))).otherwise(located)
    entry = F.concat(F.lit('"'), ident, F.lit('": {"question": "'), e, F.lit('", "answers": ['), answer, F.lit("]}"))
    doc = F.floor(F.col("event_id") / 100)
    raw = t.events.groupBy(doc.alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))), lambda s: s["x"]).alias("all"))
    raw = raw.select("doc", F.col("doc").cast("string").alias("docId"), F.concat(F.lit("{"), F.array_join("all", ", "), F.lit("}")).alias("qa"))
    language = lambda q: F.when(q.isin("click", "view"), "en").when(q == "error", F.lit(None)).otherwise("fr")
    out = standardize.flatten_documents(raw, language, order="doc", skip=100, most=1000)
    return out.select("docId", "questionId", "question", F.col("answers")[0]["page"].alias("page"), F.col("answers")[0]["value"].alias("answer"))


@query("SELECT p_partkey, 'Brand' AS split, CASE WHEN p_size % 2 = 0 THEN '/img/' || p_name ELSE p_name END AS path FROM part")
def split_names(t: Tables) -> DataFrame:
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("./img/"), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", runs.split_name(F.concat(F.lit("Brand_"), "p_brand", F.lit("_300"))).alias("split"), runs.image_path(path, "").alias("path"))


# --- corruption

OBJECTS = """pt AS (SELECT l_orderkey AS qid, p_brand AS page_id, l_linenumber AS obj_ord, l_partkey AS ent_ord, p_type AS label, p_name AS text, CAST(l_suppkey AS VARCHAR) AS obj_id, p_size AS x
    FROM lineitem JOIN part ON p_partkey = l_partkey),
  e AS (SELECT DISTINCT o.o_orderkey AS qid, f.label, f.text FROM orders o JOIN (SELECT qid, arg_min(label, {'o': obj_ord, 'e': ent_ord, 'i': obj_id}) AS label, arg_min(text, {'o': obj_ord, 'e': ent_ord, 'i': obj_id}) AS text FROM pt GROUP BY qid) f ON f.qid = o.o_orderkey
    WHERE o.o_orderstatus <> 'P'),
  m AS (SELECT pt.* FROM e JOIN pt USING (qid, label) WHERE lower(pt.text) <> lower(e.text))"""


def objects(t: Tables) -> DataFrame:
    """Entities of layout objects: a line's part is an entity of the object with its line number; pages are in the order of brands."""
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("qid"), F.col("p_brand").alias("page_ord"), F.col("l_linenumber").alias("obj_ord"), F.col("l_partkey").alias("ent_ord"), F.col("p_type").alias("label"), F.col("p_name").alias("text"),
        F.col("p_brand").alias("page_id"), F.col("l_suppkey").cast("string").alias("obj_id"), F.array(F.col("p_size")).alias("bbox"), F.lit("text").alias("layout_type"), F.lit("text1").alias("layout_type_id"))


@query(f"""WITH {OBJECTS},
  k AS (SELECT qid, page_id, obj_ord, count(*) AS k FROM m GROUP BY ALL),
  c AS (SELECT qid, page_id, obj_ord, coalesce(sum(k) OVER (PARTITION BY qid ORDER BY page_id, obj_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
  n AS (SELECT m.qid, lower(text) AS low, text, page_id, x, obj_id || '_entity_' || before AS obj_id, obj_ord, ent_ord FROM m JOIN c USING (qid, page_id, obj_ord)),
  d AS (SELECT qid, low, text, page_id, x, obj_id, min({{'p': page_id, 'o': obj_ord, 'e': ent_ord}}) AS pl FROM n GROUP BY ALL),
  g AS (SELECT qid, low, min(pl) AS first, count(*) AS places, string_agg(obj_id, ',' ORDER BY pl, page_id, x, obj_id) AS ids FROM d GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first, low) AS rank FROM g)
  SELECT qid, CAST(rank AS INT) AS rank, low, CAST(places AS INT) AS places, ids FROM r WHERE rank <= 5""")
def candidate_occurrences(t: Tables) -> DataFrame:
    """The first entity of each question that has an answer location (orders of status P have none)."""
    own = objects(t)
    firsts = own.groupBy("qid").agg(F.min(F.struct("obj_ord", "ent_ord", "obj_id", "label", "text")).alias("f")).select("qid", F.lit(1).alias("ord"), "f.label", "f.text")
    located = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qid"))
    found = C.occurrences(C.gated(firsts, located), own)
    return found.select("qid", "rank", "low", F.size("places").alias("places"), F.array_join(F.transform("places", lambda p: p["obj_id"]), ",").alias("ids"))


@query("""SELECT l_orderkey AS qid, string_agg(p_name || '|' || p_type || '|' || p_brand, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS entities, string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def renamed_layouts(t: Tables) -> DataFrame:
    own = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("p_name").alias("text"), F.lit("p").alias("page_id"), F.array(F.lit(1)).alias("bbox"), F.lit("o").alias("obj_id"), F.col("p_type").alias("layout_type"), F.col("p_brand").alias("layout_type_id")).alias("e"))
    grouped = own.groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["e"]).alias("e"))
    renamed = F.transform(C.renamed_layout(F.col("e")), lambda e: F.concat_ws("|", e["text"], e["objectType"], e["layout_type_id"]))
    return grouped.select("qid", F.array_join(renamed, ";").alias("entities"), X.entities_string(F.transform("e", lambda e: e["text"])).alias("text"))


@query("""WITH r AS (SELECT count(*) AS total_questions, count(*) FILTER (WHERE o_orderstatus = 'F') AS corrupted_questions FROM orders),
  l AS (SELECT p_type AS label, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT total_questions, corrupted_questions, string_agg(label || ':' || n, ',' ORDER BY label) AS entity_types FROM r, l GROUP BY ALL""")
def corruption_metadata(t: Tables) -> DataFrame:
    kinds = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("p_type").alias("entity_type"))
    records = t.orders.join(kinds, "o_orderkey", "left").select("entity_type", (F.col("o_orderstatus") == "F").alias("is_corrupted"))
    return sft.corruption_metadata(records).withColumn("entity_types", F.array_join(F.transform(F.array_sort(F.map_entries("entity_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@query("""SELECT p_partkey, 'Rewrite the question so that it reads well. Keep these terms as they are: ' || CASE WHEN p_brand = p_name THEN p_brand ELSE p_name || ', ' || p_brand END || chr(10) || 'Original question: ' || p_type || chr(10) || 'Question to rewrite: '
  || p_name || chr(10) || 'Rewritten question: ' AS prompt, p_name AS rewritten FROM part""")
def rewritten(t: Tables) -> DataFrame:
    entities = F.array(*(F.struct(F.col(c).alias("text")) for c in ("p_name", "p_brand", "p_name")))
    variants = t.part.select("p_partkey", F.col("p_type").alias("original_question"), F.col("p_name").alias("corrupted_question"), entities.alias("corrupted_entities"))
    return models.rewrite_questions(variants).select("p_partkey", "prompt", "rewritten")


# --- enrichment: a third of the questions lists its entities, a third writes them in one text, a third says nothing


@query(f"""WITH {K.L}, g AS (SELECT lower(trim(text)) AS key, min({{'l': label, 't': text}}) AS m FROM l WHERE label = 'PROMO' GROUP BY 1),
  o AS (SELECT qid, lower(trim(text)) AS key, min({{'l': label, 't': text}}) AS m FROM l WHERE ord <= 2 GROUP BY ALL), c AS (SELECT qid, lower(trim(text)) AS key, min({{'l': label, 't': text}}) AS m FROM l WHERE ord > 4 GROUP BY ALL),
  n AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord) - 1 AS ord, text FROM l WHERE qid % 3 <> 2)
  SELECT n.qid, CAST(n.ord AS INT) AS ord, coalesce(g.m.t, o.m.t, c.m.t, n.text) AS text, coalesce(g.m.l, o.m.l, c.m.l) AS label,
    CASE WHEN g.key IS NOT NULL THEN 'global' WHEN o.key IS NOT NULL THEN 'original' WHEN c.key IS NOT NULL THEN 'corrupted' ELSE 'none' END AS source
  FROM n LEFT JOIN g ON g.key = lower(trim(n.text)) LEFT JOIN o ON o.qid = n.qid AND n.qid % 3 = 0 AND o.key = lower(trim(n.text)) LEFT JOIN c ON c.qid = n.qid AND n.qid % 3 = 0 AND c.key = lower(trim(n.text))
  UNION ALL SELECT qid, CAST(ord AS INT), text, label, 'original' FROM l WHERE qid % 3 = 2 AND ord <= 2""")
def question_entity_forms(t: Tables) -> DataFrame:
    own = K.lines(t)
    texts = own.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    listed = F.when(F.col("qid") % 3 == 0, F.transform("texts", lambda x, i: F.struct(i.alias("ord"), x.alias("text"))))
    written = F.when(F.col("qid") % 3 == 1, F.concat(F.lit(" , "), F.array_join("texts", " ,"), F.lit(",")))
    out = enrich.question_entities_of_any_form(texts.select("qid", listed.alias("listed"), written.alias("written")), own.where("label = 'PROMO'").select("text", "label"), own.where("ord <= 2"), own.where("ord > 4"))
    return out.select("qid", F.col("ord").cast("int").alias("ord"), "text", "label", "source")


@query("""WITH x AS (SELECT l_orderkey, bool_or(p_size = 7) AS gone FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
  SELECT count(*) AS total, count(*) FILTER (WHERE gone) AS skipped, count(*) FILTER (WHERE NOT gone) AS kept FROM x""")
def skipped_items(t: Tables) -> DataFrame:
    pool = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_set("l_partkey").alias("paths"))
    kept, counted = verify.skip_without_images(pool, "paths", t.part.where("p_size <> 7").select(F.col("p_partkey").alias("path")))
    return counted.crossJoin(kept.agg(F.count("*").alias("kept")))


# --- examples and hooks


@query("""SELECT c_custkey, '<image>' || chr(10) || c_name AS input, 'Unable to determine. The term ''' || c_mktsegment || ''' refers to a corrupted entity not present as a data point in this context.' AS output
  FROM customer WHERE c_nationkey % 5 <> 0 AND c_acctbal > 0 AND c_nationkey % 3 <> 0""")
def refusal_examples(t: Tables) -> DataFrame:
    """Customers without a question, an entity or an image give none."""
    entities = F.when(F.col("c_nationkey") % 5 != 0, F.array(F.struct(F.col("c_mktsegment").alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))
    image = F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).otherwise("").alias("image_path"))
    out = sft.refusal_examples(t.customer.select(F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).alias("corrupted_question"), entities.alias("corrupted_entities"), image.alias("verification_result")), "")
    return out.select(F.col("images")[0].cast("long").alias("c_custkey"), "input", "output")


@query("""SELECT o_orderkey, 'page' || least(o_orderkey % 4 + 1, greatest(o_orderkey % 3, 1)) AS image, o_orderpriority AS output FROM orders WHERE o_orderkey % 3 > 0""")
def clean_examples(t: Tables) -> DataFrame:
    n = (F.col("o_orderkey") % 3).cast("int")
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("page"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    own = t.orders.select(F.col("o_orderkey").cast("string").alias("question"), pages.alias("document"), (F.col("o_orderkey") % 4).cast("int").alias("answer_page_idx"), F.array("o_orderpriority").alias("answers"))
    out = sft.clean_examples(own, "")
    return out.select(F.replace("input", F.lit("<image>\n"), F.lit("")).cast("long").alias("o_orderkey"), F.col("images")[0].alias("image"), "output")


@query("""SELECT k, row_number() OVER (ORDER BY md5('42:{"k":' || k || '}')) - 1 AS place FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)""")
def shuffled_union(t: Tables) -> DataFrame:
    return sft.shuffled_union([t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))])


@query(f"SELECT event_id, lower(answer) = 'not available' AS unable FROM (SELECT event_id, {Q.ANSWER} AS answer FROM events)")
def unable(t: Tables) -> DataFrame:
    raw = Q.free_text(t).withColumn("c", F.when(F.col("answer") == "Not available", "Unable TO determine").when(F.col("answer") == "", F.lit(None)).when(F.startswith("answer", F.lit("$")), "unable to determine.").otherwise(F.col("answer")))
    return raw.select("event_id", M.is_unable(F.col("c")).alias("unable"))


@query("SELECT l_orderkey AS qid, l_linenumber AS win, 'mock answer ' || length(l_shipdate::VARCHAR) AS answer, false AS is_error FROM lineitem WHERE l_linestatus = 'O'")
def answered_sides(t: Tables) -> DataFrame:
    windows = t.lineitem.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("win"), F.when(F.col("l_linestatus") == "O", "corrupted").otherwise("clean").alias("side"), F.col("l_shipdate").cast("string").alias("prompt"))
    return models.evaluate(windows, F.col("prompt"), ["corrupted"]).select("qid", "win", "answer", "is_error")


@query("""SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') AND p_size % 3 = 1 THEN 'seen ' || p_name ELSE 'read ' || p_name END AS text FROM part""")
def routed_text(t: Tables) -> DataFrame:
    objects_ = t.part.select("p_partkey", "p_name", "p_size", F.when(F.col("p_type") == "SMALL", "table").when(F.col("p_type") == "LARGE", "figure").otherwise("title").alias("type"))
    describe = lambda df: df.withColumn("text", F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("seen "), "p_name")).when(F.col("p_size") % 3 == 0, "Error: none"))
    recognise = lambda df: df.withColumn("text", F.concat(F.lit("read "), "p_name"))
    return models.route_text(objects_, describe, recognise).select("p_partkey", "text")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_yet_answered(t: Tables) -> DataFrame:
    return models.not_yet(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def only_new(t: Tables) -> DataFrame:
    return incremental.only_new(t.documents.select("doc_id"), t.labels, ["doc_id"])


@fixed("SELECT label, CAST(n AS INT) AS n FROM (VALUES " + ", ".join(f"('{label}', {i})" for i, label in enumerate(x for m in ("TEMPORAL", "LOCATION") for x in MACRO_ENTITIES[m])) + ") v(label, n)")
def enabled_labels(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(M.enabled_labels({"LOCATION": True, "TEMPORAL": True, "ENTITY": False}))), "n int, label string").select("label", "n")


CONDITIONS = [("DUDE", "random", 2), *(("DUDE", "handpicked", k) for k in (2, 4, 6)), ("MPDocVQA", "random", 2), *(("MPDocVQA", "handpicked", k) for k in (2, 4, 6))]


@fixed("SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{s}', {k}, 'runs/eval_val_100_x/{d}/fewshot_k{k}_mixed_{s}')" for d, s, k in CONDITIONS) + ") v(dataset, selection, k, leaf)")
def sweep_conditions(t: Tables) -> DataFrame:
    made = [(c["dataset"], c["few_shot"]["selection"], c["few_shot"]["n_shots"]) for c in runs.conditions(["DUDE", "MPDocVQA"])]
    leaf = lambda d, s, k: runs.resolve_leaf("runs/", d, f"fewshot_k{k}_mixed_{s}", "val", 100, "y", {"RUN_ID": "eval_val_100_x"})
    return t.spark.createDataFrame([(d, s, k, leaf(d, s, k)) for d, s, k in made], "dataset string, selection string, k int, leaf string")


TEMPLATE = "'For this question, you have the following OCR text:'"


@query(f"""SELECT p_partkey, '{X.ROLE} and text. {X.TASK}' || chr(10) || chr(10) || {TEMPLATE} || chr(10) || p_brand || chr(10) || chr(10) || 'Guidelines:' || chr(10) || '{X.CONCISE}' || chr(10)
  || '- Base your answer on both the image and the provided OCR text' || chr(10) || '{X.REFUSAL_LINES.replace("'", "''")}' || chr(10) || 'Question: ' || p_name AS prompt FROM part""")
def prompt_with_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.prompt(F.col("p_name"), F.col("p_brand"), True).alias("prompt"))


# --- report frames


def suite(t: Tables) -> DataFrame:
    """The suite as a table of its own: the parts of a report read it several times."""
    return incremental.written(B.metric_suite(t), "suite")


SUITE = f"suite AS ({B.suite_sql()}), known AS (SELECT metric, bucket, complexity, n, hits, coalesce(value, 0) AS value FROM suite)"


@query(f"""WITH {SUITE}, u AS (SELECT CASE WHEN CAST(bucket AS INT) BETWEEN 1 AND 4 THEN '<4pg' WHEN CAST(bucket AS INT) BETWEEN 5 AND 8 THEN '4pg-8pg' WHEN CAST(bucket AS INT) BETWEEN 9 AND 100 THEN '>8pg' END AS bin, value
    FROM known WHERE metric = 'QUR_PL' AND complexity = 0 AND CAST(bucket AS INT) NOT IN (5, 6, 17, 20))
  SELECT CAST(1 AS INT) AS part, CASE complexity WHEN 0 THEN 'QUR' ELSE 'QUR_C' || complexity END AS row_, value FROM known WHERE metric = 'QUR'
  UNION ALL SELECT 2, bucket, value * CASE bucket WHEN '<15' THEN 1.0::DOUBLE WHEN '15-25' THEN 0.16::DOUBLE ELSE 0.336::DOUBLE END FROM known WHERE metric = 'QUR_DED' AND complexity = 0
  UNION ALL SELECT 3, b.v, avg(u.value) FROM (VALUES {B.values(reports.PAGE_BINS)}) b(v) LEFT JOIN u ON u.bin = b.v GROUP BY b.v
  UNION ALL SELECT 4, bucket, value FROM known WHERE metric = 'QUR_NLPE' AND complexity = 0""")
def summary_qur(t: Tables) -> DataFrame:
    return reports.summary_table(suite(t), "QUR").withColumnRenamed("row", "row_")


@query(f"""WITH {SUITE} SELECT CAST(1 AS INT) AS part, CASE complexity WHEN 0 THEN 'UR' ELSE 'UR_C' || complexity END AS row_, value FROM known WHERE metric = 'UR' AND complexity = 0
  UNION ALL SELECT 2, bucket, value FROM known WHERE metric = 'UR_PAGE_DED' AND complexity = 0 UNION ALL SELECT 3, CASE bucket WHEN 'true' THEN 'UR_inpage' ELSE 'UR_outpage' END, value FROM known WHERE metric = 'UR_PAGE' AND complexity = 0
  UNION ALL SELECT 4, bucket, value FROM known WHERE metric = 'UR_NLPE' AND complexity = 0""")
def summary_ur(t: Tables) -> DataFrame:
    return reports.summary_table(suite(t), "UR").withColumnRenamed("row", "row_")


@query(f"""WITH {SUITE} SELECT metric, bucket, value FROM known WHERE complexity = 0 AND (metric = 'UR_PAGE_QP' OR (metric = 'UR_PAGE_DE' AND bucket IN ({', '.join(f"'{x}'" for x in reports.IN_PAGE_TYPES)})))""")
def in_page_tables(t: Tables) -> DataFrame:
    own = suite(t)
    parts = [reports.in_page_table(own, m).select(F.lit(m).alias("metric"), "bucket", "value") for m in ("UR_PAGE_QP", "UR_PAGE_DE")]
    return parts[0].unionByName(parts[1])


def by_status(t: Tables, side: str | None = None) -> DataFrame:
    """(dataset, config, complexity, value): question refusal rates, overall as complexity 0; a status is a configuration."""
    config = F.when(F.col("o_orderstatus") == "P", "fewshot_ocr_k2_mixed_random").when(F.col("o_orderstatus") == "O", "zeroshot_noocr").otherwise("finetuned_ocr")
    own = t.orders.select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("complexity"), F.col("o_orderpriority").alias("dataset"), config.alias("config"))
    rows = M.refused(own, B.answers(t, side)).groupingSets([["dataset", "config"], ["dataset", "config", "complexity"]], "dataset", "config", "complexity").agg((F.count_if("hit") / F.count("*")).alias("value"))
    return rows.withColumn("complexity", F.coalesce("complexity", F.lit(0)))


def status_sql(name: str, answers: str = "a") -> str:
    return f"""{name}_s AS (SELECT qid, count(*) AS k, count(*) FILTER (WHERE is_unable) AS u FROM {answers} GROUP BY qid),
  {name}_q AS (SELECT o_orderkey AS qid, o_orderkey % 3 + 1 AS complexity, o_orderpriority AS dataset, CASE o_orderstatus WHEN 'P' THEN 'fewshot_ocr_k2_mixed_random' WHEN 'O' THEN 'zeroshot_noocr' ELSE 'finetuned_ocr' END AS config FROM orders),
  {name} AS (SELECT dataset, config, coalesce(complexity, 0) AS complexity, CAST(count(*) FILTER (WHERE coalesce(k > 0 AND k = u, false)) AS DOUBLE) / count(*) AS value FROM {name}_q LEFT JOIN {name}_s USING (qid) GROUP BY GROUPING SETS ((dataset, config), (dataset, config, complexity)))"""


def wide(value: str, name: str) -> str:
    return ", ".join(f"max({value}) FILTER (WHERE complexity = {c}) AS {name}" + (f"_C{c}" if c else "") for c in range(4))


@query(f"""WITH {B.A}, {status_sql('x')}, w AS (SELECT dataset, config, {wide('value', 'QUR')} FROM x GROUP BY ALL)
  SELECT dataset, config, QUR, QUR_C1, QUR_C2, nullif(QUR_C3, 0) AS QUR_C3, CASE WHEN config LIKE 'fewshot%' THEN 2 END AS k, CASE WHEN config LIKE 'fewshot%' THEN 'random' END AS selection, split_part(config, '_', 1) AS strategy FROM w""")
def sweep_frame(t: Tables) -> DataFrame:
    return reports.sweep_frame(by_status(t))


CLEAN = "b AS (SELECT * FROM a WHERE l_linestatus = 'F')"


@query(f"""WITH {B.A}, {CLEAN}, {status_sql('x')}, {status_sql('y', 'b')}, q AS (SELECT dataset, {wide('value', 'QUR')} FROM x WHERE config = 'finetuned_ocr' GROUP BY ALL), f AS (SELECT dataset, {wide('value', 'FRR')} FROM y WHERE config = 'finetuned_ocr' GROUP BY ALL)
  SELECT dataset, QUR, QUR_C1, QUR_C2, CASE WHEN coalesce(QUR_C3, 0) <> 0 THEN QUR_C3 END AS QUR_C3, FRR, FRR_C1, FRR_C2, CASE WHEN coalesce(QUR_C3, 0) <> 0 THEN FRR_C3 END AS FRR_C3 FROM q JOIN f USING (dataset)""")
def tuned_frame(t: Tables) -> DataFrame:
    own = lambda side: by_status(t, side).where("config = 'finetuned_ocr'").select("dataset", "complexity", "value")
    return reports.tuned_frame(own(None), own("clean"))


@query(f"""WITH {B.A}, {CLEAN}, {status_sql('x')}, {status_sql('y', 'b')}
  SELECT x.config AS model, avg(nullif(y.value, 0)) AS frr, avg(x.value) AS qur FROM x JOIN y ON y.dataset = x.dataset AND y.config = x.config AND y.complexity = 0 WHERE x.complexity = 0 AND y.value <> 0 GROUP BY 1""")
def model_means(t: Tables) -> DataFrame:
    """Configurations stand for models of one strategy; rates of 0 stand for no result."""
    q = by_status(t).where("complexity = 0").select("dataset", "config", F.col("value").alias("qur"))
    f = by_status(t, "clean").where("complexity = 0").select("dataset", "config", reports.sentinel(F.col("value")).alias("frr"))
    return reports.model_means(q.join(f, ["dataset", "config"]).select(F.col("config").alias("model"), F.lit("finetuned").alias("strategy"), "frr", "qur"))


@query(f"""WITH {R.CELLS}, {R.TOTAL}, d AS (SELECT dataset, max(value) FILTER (WHERE strategy = 'zeroshot') AS b, max(value) FILTER (WHERE strategy = 'finetuned') AS a FROM tot WHERE NOT (dataset = '5-LOW' AND strategy = 'finetuned') GROUP BY dataset)
  SELECT 'stub' AS model, avg(b) AS before, avg(a) AS after, avg(a) - avg(b) AS delta, (avg(a) - avg(b)) / CASE WHEN 1 - avg(b) > 0 THEN 1 - avg(b) END AS gain FROM d WHERE a IS NOT NULL AND b IS NOT NULL""")
def macro_headroom(t: Tables) -> DataFrame:
    """A dataset without one of the two values counts for neither mean."""
    rows = R.totals(t).where("not (dataset = '5-LOW' and strategy = 'finetuned')").withColumn("model", F.lit("stub"))
    return reports.macro_headroom(rows, ["model"])


@query(f"""WITH {B.Q}, {B.A}, {B.P}, {B.E}, {B.R}, k AS (SELECT complexity, macro, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS value FROM r JOIN e USING (qid) GROUP BY ALL)
  SELECT CAST(complexity AS INT) AS complexity, {', '.join(f"max(value) FILTER (WHERE macro = '{m}') AS {m.lower()}" for m in MACRO_ENTITIES)} FROM k GROUP BY complexity""")
def pivot_macros(t: Tables) -> DataFrame:
    rows = M.qur_by(B.questions(t), B.answers(t), B.entities(t).withColumnRenamed("macro", "bucket")).where("complexity > 0")
    return reports.pivoted(rows, ["complexity"], "bucket", list(MACRO_ENTITIES)).withColumnsRenamed({m: m.lower() for m in MACRO_ENTITIES})


@query(f"""WITH {B.A}, {status_sql('x')} SELECT config AS folder, CAST(complexity AS INT) AS row_, {', '.join(f"max(value) FILTER (WHERE dataset = '{p}') AS d{p[0]}" for p in R.PRIORITIES)} FROM x GROUP BY ALL""")
def grouped_metric(t: Tables) -> DataFrame:
    rows = by_status(t).select(F.col("config").alias("folder"), F.col("complexity").alias("row_"), "dataset", "value")
    return reports.pivoted(rows, ["folder", "row_"], "dataset", list(R.PRIORITIES)).withColumnsRenamed({p: f"d{p[0]}" for p in R.PRIORITIES})


@query(f"{R.SUMMARY.format(m='QUR').replace(chr(39) + 'orders' + chr(39), chr(39) + 'late' + chr(39))}, 'run_b' AS run_id FROM ({R.QUR_SQL})")
def comparison_filtered(t: Tables) -> DataFrame:
    constants = {"config": "zeroshot_noocr", "label": "Zero-Shot", "model": "stub"}
    runs_ = {"run_a": reports.summary(M.ur(B.questions(t), B.answers(t)), "UR", dataset="orders", **constants), "run_b": reports.summary(M.qur(B.questions(t), B.answers(t)), "QUR", dataset="late", **constants)}
    return reports.aggregate_runs(runs_, ["late", "other"])


@query("""SELECT slug, CAST(row_number() OVER (ORDER BY CASE WHEN k IS NULL THEN 0 ELSE 1 END, k NULLS FIRST, slug) AS INT) AS place FROM
  (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'zeroshot_ocr' ELSE 'fewshot_ocr_k' || (o_orderkey % 9) || '_mixed_random' END AS slug, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 9 END AS k FROM orders)""")
def configuration_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    k = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 9)
    slug = F.when(k.isNull(), "zeroshot_ocr").otherwise(F.concat(F.lit("fewshot_ocr_k"), k.cast("string"), F.lit("_mixed_random")))
    own = t.orders.select(slug.alias("slug"), k.alias("k")).distinct()
    return own.select("slug", F.row_number().over(W.partitionBy().orderBy(*reports.configuration_order(F.col("slug"), F.col("k")))).alias("place"))
