"""The smaller operators on the driver's tables: projections, orders, lookups, examples and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions import text as X
from querent.functions import windows as N
from querent.model import VISUAL_TYPES
from querent.operators import corruption as C
from querent.operators import enrich, geometry, reports, sampling, sft, standardize, verify
from querent.operators import metrics as M
from querent.plans import corruption_queries as K
from querent.plans import metric_queries as B
from querent.plans.registry import Tables, query
from querent.sources import readers, sinks


@query("""SELECT CAST(user_id AS VARCHAR) AS "docId", CAST(event_id AS VARCHAR) AS "questionId", event_type AS question, CAST(greatest(event_id % 5 - 1, 0) AS INT) AS answer_page_idx FROM events""")
def flatten_documents(t: Tables) -> DataFrame:
    one = F.struct(F.col("event_type").alias("question"), F.array(F.struct(F.lit("v").alias("value"), (F.col("event_id") % 5).cast("string").alias("page"))).alias("answers"))
    entry = F.struct(F.col("event_id").cast("string").alias("k"), one.alias("v"))
    raw = t.events.groupBy(F.col("user_id").cast("string").alias("docId"), F.floor(F.col("event_id") / 100).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("qa"))
    return standardize.standardize_flattened(standardize.flatten_documents(raw.withColumn("data_split", F.lit("train")).withColumn("document", F.array(F.lit("p"))))).select("docId", "questionId", "question", "answer_page_idx")


@query("""SELECT c_custkey, array_to_string(list_filter([c_name, CASE WHEN c_nationkey % 2 = 0 THEN 'two' END, c_mktsegment], lambda x: x IS NOT NULL), '|') AS document,
  CAST(c_nationkey AS INT) AS answer_page_idx FROM customer WHERE c_acctbal >= 0""")
def long_pages(t: Tables) -> DataFrame:
    wide = t.customer.select(
        "c_custkey", F.col("c_custkey").cast("string").alias("questionId"), F.lit("q").alias("question"), F.when(F.col("c_acctbal") >= 0, "a").alias("answer"),
        F.array(F.col("c_nationkey") + 1).alias("evidence_pages"), F.col("c_name").alias("page_1"), F.col("c_mktsegment").alias("page_10"), F.when(F.col("c_nationkey") % 2 == 0, "two").alias("page_2"))
    out = standardize.standardize_slides(standardize.long_pages(wide))
    return out.select(F.col("questionId").cast("long").alias("c_custkey"), F.array_join("document", "|").alias("document"), "answer_page_idx")


@query("SELECT p_partkey, 'img/' || p_partkey || '.jpg' AS first_page FROM part")
def standardize_paged(t: Tables) -> DataFrame:
    raw = t.part.select("p_partkey", F.col("p_partkey").alias("doc_id"), F.array(F.col("p_partkey").cast("string")).alias("page_ids"))
    return standardize.standardize_paged(raw, "img/").select("p_partkey", F.col("document")[0].alias("first_page"))


PROMPT = f"'{X.ROLE}. {X.TASK}' || chr(10) || chr(10) || 'Guidelines:' || chr(10) || '{X.CONCISE}' || chr(10) || '- Base your answer solely on what you see in the image' || chr(10)"


@query(f"SELECT p_partkey, {PROMPT} || 'Question: ' || p_name AS prompt FROM part")
def prompt(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.prompt(F.col("p_name"), None, False).alias("prompt"))


@query("SELECT p_partkey, p_name || chr(10) || 'Choice A: ' || p_brand || chr(10) || 'Choice B: ' || p_type || chr(10) || 'Answer with a letter.' AS prompt, 'Say' || chr(10) || p_name AS sft FROM part")
def choice_prompt(t: Tables) -> DataFrame:
    made = X.choice_prompt(F.col("p_name"), [F.concat(F.lit("Choice A: "), "p_brand"), F.concat(F.lit("Choice B: "), "p_type")], "Answer with a letter.")
    return t.part.select("p_partkey", made.alias("prompt"), X.sft_text(F.lit("Say"), F.concat(F.lit("<image>\n"), "p_name")).alias("sft"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE p_name || '.' END AS clean FROM part""")
def generated_cleanup(t: Tables) -> DataFrame:
    size = F.col("p_size") % 3
    raw = F.when(size == 0, F.concat(F.lit(" Rewritten question: Question: "), "p_name", F.lit("."))).when(size == 1, F.concat(F.lit('"'), "p_name", F.lit("\". "))).otherwise(F.concat("p_name", F.lit("..")))
    return t.part.select("p_partkey", F.regexp_replace(X.clean_generated(raw), '"$', "").alias("clean"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS verdict FROM events")
def parse_verdict(t: Tables) -> DataFrame:
    e = F.col("event_type")
    reply = F.when(e == "error", F.lit('```json\n{"verification_result": "True"}\n```')).when(e == "click", F.lit('json {"verification_result": "False"}')).otherwise(F.col("props"))
    return t.events.select("event_id", X.parse_verdict(reply).alias("verdict"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS layout, CASE WHEN p_size % 3 = 0 THEN './img/' || p_name ELSE p_name END AS raw,
  CASE WHEN p_size % 3 = 0 THEN '/data/img/' || p_name ELSE p_name END AS path FROM part""")
def layout_and_path(t: Tables) -> DataFrame:
    from querent.functions.runs import image_path

    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("./img/"), "p_name")).otherwise(F.col("p_name"))
    kind = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 4 == 1, "")
    return t.part.select("p_partkey", enrich.layout_of(kind, F.col("p_brand")).alias("layout"), raw.alias("raw"), image_path(raw, "/data").alias("path"))


@query(f"""WITH {K.L}, k AS (SELECT lower(trim(text)) AS key, arg_max({{'t': text, 'p': part, 'g': page_id}}, {{'q': qid, 'o': ord, 'p': part}}) AS m FROM l GROUP BY 1)
  SELECT qid, ord, coalesce(k.m.p, l.part) AS part, coalesce(k.m.g, l.page_id) AS page_id FROM l LEFT JOIN k ON k.key = lower(trim(l.text))""")
def overwrite_entities(t: Tables) -> DataFrame:
    known = enrich.global_entity_map(K.lines(t), ["qid", "ord", "part"], K.ATTRS)
    return enrich.overwrite(K.lines(t), known, K.ATTRS).select("qid", "ord", "part", "page_id")


@query(f"""WITH {K.L}, g AS (SELECT lower(trim(text)) AS key, min(label) AS label FROM l WHERE label = 'PROMO' GROUP BY 1),
  o AS (SELECT qid, lower(trim(text)) AS key, min(label) AS label FROM l WHERE ord <= 2 GROUP BY ALL), c AS (SELECT qid, lower(trim(text)) AS key, min(label) AS label FROM l WHERE ord > 4 GROUP BY ALL)
  SELECT l.qid, l.ord, coalesce(g.label, o.label, c.label) AS label, CASE WHEN g.key IS NOT NULL THEN 'global' WHEN o.key IS NOT NULL THEN 'original' WHEN c.key IS NOT NULL THEN 'corrupted' ELSE 'none' END AS source
  FROM l LEFT JOIN g ON g.key = lower(trim(l.text)) LEFT JOIN o ON o.qid = l.qid AND o.key = lower(trim(l.text)) LEFT JOIN c ON c.qid = l.qid AND c.key = lower(trim(l.text))""")
def question_entities(t: Tables) -> DataFrame:
    own = K.lines(t)
    out = enrich.question_entities(own, own.where("label = 'PROMO'").select("text", "label"), own.where("ord <= 2"), own.where("ord > 4"))
    return out.select("qid", "ord", "label", "source")


@query("""WITH o AS (SELECT l_orderkey AS qid, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag <> 'N') AS b FROM lineitem GROUP BY 1)
  SELECT qid, array_to_string(list_transform(range(least(len(a), len(b))), lambda i: a[CAST(i + 1 AS BIGINT)] || ':' || b[CAST(i + 1 AS BIGINT)]), ',') AS pairs FROM o WHERE b IS NOT NULL""")
def zip_entities(t: Tables) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(place)).alias("a"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", place))).alias("b"))
    pairs = verify.zip_entities(F.transform("a", lambda x: x["l_partkey"]), F.transform("b", lambda x: x["l_suppkey"]))
    return o.where(F.size("b") > 0).select("qid", F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["original"].cast("string"), p["corrupted"].cast("string"))), ",").alias("pairs"))


@query("""SELECT l_orderkey AS qid, string_agg(t, chr(10) ORDER BY y, p) AS ocr FROM (SELECT l_orderkey, CAST(floor(l_quantity) AS INT) % 5 AS y, l_partkey AS p, p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def verifier_order(t: Tables) -> DataFrame:
    y = F.floor("l_quantity").cast("int") % 5
    o = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", F.struct("l_partkey", F.array(F.lit(0), y).alias("BBOX"), F.col("p_name").alias("OCR")).alias("o"))
    return o.groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list("o")).alias("o")).select("qid", N.verifier_order(F.col("o")).alias("ocr"))


@query("""SELECT l_orderkey AS qid, p_type AS type, string_agg(p_name, ' ' ORDER BY y, x, p_name) AS text, min(x) || ',' || min(y) || ',' || max(x + w) || ',' || max(y + 2) AS bbox
  FROM (SELECT l_orderkey, p_type, p_name, CAST(l_suppkey % 9 AS INT) AS x, CAST(floor(l_quantity) AS INT) AS y, l_linenumber AS w FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2""")
def ocr_by_layout(t: Tables) -> DataFrame:
    x, y = (F.col("l_suppkey") % 9).cast("int"), F.floor("l_quantity").cast("int")
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("qid"), F.col("p_type").alias("type"), F.col("p_name").alias("text"), F.array(x, y, x + F.col("l_linenumber"), y + 2).alias("bbox"))
    return enrich.merged_layouts(rows, ["qid"]).withColumn("bbox", F.array_join(F.col("bbox").cast("array<string>"), ","))


@query("""SELECT l_orderkey AS qid FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size <> 7))""")
def complete_examples(t: Tables) -> DataFrame:
    pool = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_set("l_partkey").alias("paths"))
    return sampling.complete_examples(pool, t.part.where("p_size <> 7").select(F.col("p_partkey").alias("path"))).select("qid")


@query("SELECT l_orderkey AS qid, count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7) GROUP BY 1")
def missing_images(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("path"))
    return verify.missing_images(rows, t.part.where("p_size <> 7").select(F.col("p_partkey").alias("path"))).groupBy("qid").agg(F.count("*").alias("missing"))


@query("""SELECT c_custkey, c_name AS input, 'Unable to determine. The term ''' || c_mktsegment || ''' refers to a corrupted entity not present as a data point in this context.' AS output FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_custkey, c_mktsegment AS input, CAST(c_nationkey AS VARCHAR) AS output FROM customer WHERE c_acctbal > 0""")
def paired_sft(t: Tables) -> DataFrame:
    entries = t.customer.select(
        F.col("c_name").alias("corrupted_question"), F.col("c_mktsegment").alias("original_question"), F.array(F.struct(F.col("c_mktsegment").alias("text"))).alias("corrupted_entities"),
        F.array(F.struct(F.col("c_nationkey").cast("string").alias("answer"))).alias("original_answer_locations"),
        F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).alias("image_path")).alias("verification_result"))
    out = sft.paired_examples(entries, "")
    return out.select(F.col("images")[0].cast("long").alias("c_custkey"), F.replace("input", F.lit("<image>\n"), F.lit("")).alias("input"), "output")


# labels are masked but for a second one of every fourth order, and a fourth one that is beyond the cut
@query("""SELECT o_orderkey, CAST(least(3, n) AS INT) AS kept, CASE WHEN n = 0 THEN NULL WHEN n >= 2 AND o_orderkey % 4 = 0 THEN CASE WHEN n = 2 THEN 9 ELSE -100 END ELSE 7 END AS last
  FROM (SELECT o_orderkey, o_orderkey % 6 AS n FROM orders)""")
def sft_truncate(t: Tables) -> DataFrame:
    n = (F.col("o_orderkey") % 6).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    labels = F.transform(ids, lambda x: F.when((x == 4) | ((x == 2) & (F.col("o_orderkey") % 4 == 0)), 9).otherwise(-100))
    cut = sft.truncated(ids, labels, 3, 7)
    return t.orders.select("o_orderkey", F.size(cut["ids"]).alias("kept"), F.get(cut["labels"], F.size(cut["labels"]) - 1).alias("last"))


@query("SELECT p_partkey AS page, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'computed' END AS text FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def through_cache(t: Tables) -> DataFrame:
    wanted = t.lineitem.select(F.col("l_partkey").alias("page"))
    cache = t.part.select(F.col("p_partkey").alias("page"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("text"))
    return readers.through_cache(wanted, cache, lambda df: df.withColumn("text", F.lit("computed")), "page", "text")


@query("SELECT o_orderpriority AS run_id, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS leaves FROM orders GROUP BY 1")
def sweep_manifest(t: Tables) -> DataFrame:
    out = sinks.sweep_manifest(t.orders.select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("leaf")))
    return out.select("run_id", F.array_join("leaves", ",").alias("leaves"))


@query("""SELECT c_custkey AS model, coalesce(v, 0) AS value FROM customer LEFT JOIN
  (SELECT o_custkey AS m, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS v FROM orders GROUP BY 1) ON m = c_custkey""")
def zero_filled(t: Tables) -> DataFrame:
    rates = t.orders.groupBy(F.col("o_custkey").alias("model")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("value"))
    return reports.zero_filled(rates, t.customer.select(F.col("c_custkey").alias("model")).distinct())


@query("""WITH a AS (SELECT p_type AS bucket, count(*) AS value_w1 FROM part WHERE p_size % 2 = 0 GROUP BY 1), b AS (SELECT p_type AS bucket, count(*) AS value_w1_ocr FROM part WHERE p_size = 7 GROUP BY 1)
  SELECT * FROM a FULL JOIN b USING (bucket)""")
def joined_conditions(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy(F.col("p_type").alias("bucket")).agg(F.count("*").alias("value"))
    return reports.joined_conditions(count(t.part.where("p_size % 2 = 0")), count(t.part.where("p_size = 7")), ["bucket"], ("_w1", "_w1_ocr"))


@query("SELECT o_orderpriority AS dataset, arg_min(o_orderstatus, o_orderkey) AS slug, min(o_orderkey) AS ord FROM orders GROUP BY 1")
def first_slug(t: Tables) -> DataFrame:
    return reports.first_slug(t.orders.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("slug"), F.col("o_orderkey").alias("ord")), ["dataset"])


@query("""SELECT p_type AS model, string_agg(CAST(n AS VARCHAR), ',' ORDER BY slice, bucket) AS vector FROM (SELECT p_type, p_brand AS slice, p_size AS bucket, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1""")
def radar_vectors(t: Tables) -> DataFrame:
    rows = t.part.groupBy(F.col("p_type").alias("model"), F.col("p_brand").alias("slice"), F.col("p_size").alias("bucket")).agg(F.count("*").alias("value"))
    return reports.radar_vectors(rows).select("model", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"))


@query("""SELECT count(*) AS processed, count(*) FILTER (WHERE l_returnflag <> 'N') AS success, count(*) FILTER (WHERE l_returnflag = 'N') AS errors,
  CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS DOUBLE) / count(*) AS success_rate FROM lineitem""")
def run_counters(t: Tables) -> DataFrame:
    return M.run_counters(t.lineitem.select((F.col("l_returnflag") == "N").alias("is_error")))


@query("SELECT count(*) AS n, CAST(count(*) FILTER (WHERE lower(trim(l_returnflag)) = lower(trim(l_linestatus))) AS DOUBLE) / count(*) AS accuracy FROM (SELECT ' ' || o_orderstatus AS l_returnflag, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE 'x' END AS l_linestatus FROM orders)")
def answer_accuracy(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.concat(F.lit(" "), "o_orderstatus").alias("expected"), F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).otherwise("x").alias("answer"))
    return M.answer_accuracy(pairs)


@query("SELECT l_orderkey AS qid, CAST(sum(w) AS DOUBLE) / count(*) AS mean_width, CAST(sum(h) AS DOUBLE) / count(*) AS mean_height FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber * 10 AS w, l_linenumber * 7 AS h FROM lineitem) GROUP BY 1")
def mean_page_size(t: Tables) -> DataFrame:
    pages = t.lineitem.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("path"), (F.col("l_linenumber") * 10).alias("width"), (F.col("l_linenumber") * 7).alias("height"))
    return M.mean_page_size(pages)


@query(f"WITH {B.P} SELECT layout_type AS label, CASE WHEN layout_type IN {B.VISUAL} THEN 'vre' ELSE 'text' END AS kind, count(*) AS n FROM p GROUP BY ALL")
def layout_kinds(t: Tables) -> DataFrame:
    from querent.model import layout_kinds, require_mapped

    out = B.parts(t).join(F.broadcast(layout_kinds(t.spark)), "layout_type", "left")
    return require_mapped(out, "layout_type", "kind").groupBy(F.col("layout_type").alias("label"), "kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn * 2 + r AS place, CASE WHEN r = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM (SELECT conv_id, turn, text FROM conversations), (VALUES (0), (1)) v(r)")
def few_shot_turns(t: Tables) -> DataFrame:
    shot = F.struct(F.array(F.lit("p")).alias("image_paths"), F.col("text").alias("question"), F.col("text").alias("answer"))
    made = t.conversations.select("conv_id", "turn", F.posexplode(sft.few_shot_turns(F.array(shot))).alias("i", "s"))
    return made.select("conv_id", (F.col("turn") * 2 + F.col("i")).alias("place"), "s.role", "s.text")


@query(f"WITH {K.L} SELECT qid, CAST(ord + 1 AS INT) AS number, CASE WHEN i = 1 THEN 'shot' ELSE text END AS path FROM (SELECT qid, 0 AS ord, '' AS text, 1 AS i FROM l GROUP BY qid UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord) AS ord, text, 2 AS i FROM l)")
def numbered_images(t: Tables) -> DataFrame:
    pages = K.lines(t).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("pages"))
    shot = F.array(F.struct(F.array(F.lit("shot")).alias("image_paths")), F.struct(F.lit(None).cast("array<string>").alias("image_paths")))
    return pages.select("qid", F.explode(N.numbered_images(shot, F.col("pages"))).alias("p")).select("qid", "p.number", "p.path")


@query("""WITH g AS (SELECT c.v AS c, r.v AS r, row_number() OVER (ORDER BY c.v * r.v, c.v) AS i FROM range(1, 13) c(v), range(1, 13) r(v) WHERE c.v * r.v <= 12),
  x AS (SELECT p_partkey, width, height, g.*, abs(CAST(width AS DOUBLE) / height - CAST(c AS DOUBLE) / r) AS d, width * height > 0.5 * 448 * 448 * c * r AS roomy
    FROM (SELECT p_partkey, p_size * 40 AS width, 800 AS height FROM part) , g),
  y AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, i) AS n, min(d) OVER (PARTITION BY p_partkey) AS least FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i DESC) AS last FROM y WHERE d = least AND (n = 1 OR roomy))
  SELECT p_partkey, width, height, CAST(c AS INT) AS tile_columns, CAST(r AS INT) AS tile_rows FROM z WHERE last = 1""")
def tile_grid(t: Tables) -> DataFrame:
    return geometry.tile_grid(t.part.select("p_partkey", (F.col("p_size") * 40).alias("width"), F.lit(800).alias("height")))


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || left(md5('42:' || o_orderkey), 8) AS BIGINT) % 4 = 1")
def shards(t: Tables) -> DataFrame:
    return sampling.shard(t.orders, "o_orderkey", 1, 4).select("o_orderkey")


@query(f"WITH {B.Q}, {B.A}, {B.R} SELECT CAST(avg(v) AS DOUBLE) AS value FROM (SELECT complexity, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS v FROM r GROUP BY 1)")
def macro_average(t: Tables) -> DataFrame:
    rows = M.qur(B.questions(t), B.answers(t)).where("complexity > 0")
    return reports.macro_average(rows, []).select("value")


@query("SELECT p_partkey, lower(replace(replace(p_name, ' ', ''), '_', '')) AS form FROM part")
def containment_form(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.containment_form(F.col("p_name")).alias("form"))


@query(f"""{K.POOLS}, x AS (SELECT qid, ord, count(*) AS n FROM pools GROUP BY ALL) SELECT qid, CAST(sum(n) AS BIGINT) AS variants FROM x GROUP BY qid""")
def variants_of_one(t: Tables) -> DataFrame:
    questions = t.orders.select(F.col("o_orderkey").alias("qid"), F.lit("").alias("question"))
    return C.corrupt(questions, K.lines(t), K.entity_pools(t), complexity=1).groupBy("qid").agg(F.count("*").alias("variants"))


@query("""WITH o AS (SELECT l_orderkey AS qid, l_linenumber AS page, string_agg(p_name, chr(10) ORDER BY l_suppkey % 5, l_partkey % 9, p_name) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
  SELECT qid, string_agg('Page ' || n || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS ocr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY page) AS n FROM o) WHERE n <= 2 GROUP BY qid""")
def numbered_texts(t: Tables) -> DataFrame:
    box = F.array((F.col("l_partkey") % 9).cast("int"), (F.col("l_suppkey") % 5).cast("int"))
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", F.struct(box.alias("BBOX"), F.col("p_name").alias("OCR")).alias("o"))
    pages = rows.groupBy(F.col("l_orderkey").alias("qid"), "l_linenumber").agg(F.collect_list("o").alias("objects"))
    docs = pages.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.struct(F.col("l_linenumber").cast("string").alias("path"), "objects").alias("p")))).alias("a"))
    made = docs.select("qid", F.transform("a", lambda x: x["p"]).alias("pages")).select("qid", N.page_texts(F.col("pages")).alias("texts"), F.transform("pages", lambda p: p["path"]).alias("document"))
    return made.select("qid", N.numbered_texts(F.col("document"), F.slice("document", 1, 2), F.col("texts")).alias("ocr"))


@query("SELECT o_orderpriority AS dataset, o_orderstatus AS element, n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n, o_orderstatus) AS place FROM (SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL)")
def elements_by_mean(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("element")).agg(F.count("*").cast("double").alias("value"))
    return reports.by_mean(reports.positive(rows), "element").select("dataset", "element", F.col("mean").alias("n"), F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, coalesce(c_name, 'model') AS model_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def with_manifest(t: Tables) -> DataFrame:
    names = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("model_name"))
    return reports.with_manifest(t.orders, names, ["o_custkey"]).select("o_orderkey", "model_name")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 100")
def head_truncation(t: Tables) -> DataFrame:
    return sampling.head(t.part.select("p_partkey"), "p_partkey", 100)


@query("SELECT page_id AS path, base64(encode(url)) AS base64 FROM pages")
def encode_image(t: Tables) -> DataFrame:
    return readers.encoded(t.pages.select(F.col("page_id").alias("path"), F.col("url").cast("binary").alias("content")))


@query("""SELECT DISTINCT l_orderkey AS qid, l_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'cached' ELSE 'detected' END AS source FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 5 <> 0 AND p_size % 7 <> 0""")
def analyse_pages(t: Tables) -> DataFrame:
    from querent.operators.models import analyse_pages

    documents = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_set("l_partkey").alias("document"))
    parts = t.part.select(F.col("p_partkey").alias("path"), "p_size")
    cache = parts.where("p_size % 2 = 0").select("path", F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("cached"))).alias("objects"))
    sizes = parts.select("path", "p_size")
    detect = lambda df: df.join(sizes, "path").select("path", F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("detected"))).alias("objects"))
    out = analyse_pages(documents, parts.where("p_size % 5 <> 0"), cache, detect)
    return out.select("qid", "path", F.col("objects")[0].alias("source"))


@query("SELECT p_partkey AS obj, string_agg(w, '|' ORDER BY i) AS entities FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) WHERE length(w) > 3 GROUP BY 1")
def object_entities(t: Tables) -> DataFrame:
    from querent.operators.models import object_entities

    objects = t.part.select(F.col("p_partkey").alias("obj"), F.col("p_name").alias("OCR"))
    words = lambda df: df.select("obj", F.posexplode(F.split("OCR", " ")).alias("ent_ord", "text")).where("length(text) > 3").select("*", F.lit("x").alias("label"), F.lit(1.0).alias("score"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    return object_entities(objects, words, ["obj"]).select("obj", F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("entities"))
