"""Corruption, enrichment and verification on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.model import DEFAULT_THRESHOLD
from querent.operators import corruption as C
from querent.operators import enrich as N
from querent.operators import geometry as G
from querent.operators import verify as V
from querent.plans.registry import Tables, query


def lines(t: Tables) -> DataFrame:
    """Entities of a question: one for each line number of an order, the smallest part where numbers repeat."""
    one = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("part"))
    p = t.part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("text"), F.col("p_type").alias("label"), F.col("p_brand").alias("page_id"))
    return one.join(p, "part")


L = """l AS (SELECT o.qid, o.ord, o.part, p_name AS text, p_type AS label, p_brand AS page_id
  FROM (SELECT l_orderkey AS qid, l_linenumber AS ord, min(l_partkey) AS part FROM lineitem GROUP BY ALL) o JOIN part ON p_partkey = o.part)"""


# of each benchmark text the whole, and its first one to four words joined by underscores
SHORT = "array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')[1:item_id % 4 + 1], '_')"


@query(f"""WITH a AS (SELECT item_id, 0 AS words, text AS answer FROM benchmark UNION ALL SELECT item_id, CAST(item_id % 4 + 1 AS INT), {SHORT} FROM benchmark),
  f AS (SELECT item_id, words, lower(regexp_replace(answer, '[\\s_]+', '', 'g')) AS form FROM a WHERE answer IS NOT NULL),
  d AS (SELECT doc_id, md5(text) AS digest, lower(regexp_replace(text, '[\\s_]+', '', 'g')) AS form FROM documents WHERE text IS NOT NULL)
  SELECT doc_id AS qid, item_id, words, digest FROM d JOIN f ON f.form <> '' AND contains(d.form, f.form)""")
def answer_locations(t: Tables) -> DataFrame:
    """Whole benchmark texts and their first one to four words in all documents."""
    from querent.operators.answers import answers_in_texts, key_of

    words = F.filter(F.split("text", "[ \\t\\n\\r\\f]+", -1), lambda w: w != "")
    short = F.array_join(F.slice(words, F.lit(1), F.col("item_id") % 4 + 1), "_")
    answers = t.benchmark.select("item_id", F.lit(0).alias("words"), F.col("text").alias("answer")).unionByName(t.benchmark.select("item_id", (F.col("item_id") % 4 + 1).cast("int").alias("words"), short.alias("answer")))
    found = answers_in_texts(t.documents, answers).drop("places")
    docs = t.documents.select(F.col("doc_id").alias("qid"), key_of(F.col("text")).alias("text_key"), F.md5("text").alias("digest"))
    own = answers.select("item_id", "words", key_of(F.col("answer")).alias("answer_key"))
    return found.join(docs, "text_key").join(own, "answer_key").select("qid", "item_id", "words", "digest")


@query(r"""SELECT a.p_partkey AS qid, o.p_partkey AS obj_ord FROM part a JOIN part o ON a.p_brand = o.p_brand
  AND contains(lower(regexp_replace(o.p_name, '[\s_]+', '', 'g')), lower(regexp_replace(string_split(a.p_name, ' ')[1] || '_', '[\s_]+', '', 'g')))""")
def page_answers(t: Tables) -> DataFrame:
    """A part's brand is its page, its name an object there, and the first word of its name an answer."""
    objects = t.part.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("obj_ord"), F.col("p_name").alias("text"))
    answers = t.part.select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("page"), F.lit(0).alias("ans_ord"), F.concat(F.split("p_name", " ")[0], F.lit("_")).alias("answer"))
    return C.answer_locations(objects, answers).select("qid", "obj_ord")


STEM = "regexp_extract(url, 'https?://([^./]+)', 1)"


# names of hosts up to their first dot: th is a prefix of ththre as well, as documents are of others' files
@query(f"""SELECT page_id, d.doc AS host FROM pages JOIN (SELECT DISTINCT {STEM} AS doc FROM pages) d ON starts_with(regexp_replace(url, '^https?://', ''), d.doc) AND d.doc <> ''""")
def prefix_pages(t: Tables) -> DataFrame:
    from querent.sources.readers import pages_of_documents

    documents = t.pages.select(F.regexp_extract("url", "https?://([^./]+)", 1).alias("doc")).where("doc <> ''")
    files = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("file"))
    return pages_of_documents(documents, files, strict=False).select("page_id", F.col("doc").alias("host"))


@query("SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages WHERE contains(regexp_replace(url, '^https?://', ''), '/')")
def strict_pages(t: Tables) -> DataFrame:
    from querent.sources.readers import pages_of_documents

    documents = t.pages.select(F.regexp_extract("url", "https?://([^/]+)", 1).alias("doc"))
    files = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("file"))
    return pages_of_documents(documents, files.where("contains(file, '/')"), separator="/").select("page_id", F.col("doc").alias("host"))


POOLS = f"""WITH {L}, c AS (SELECT label, lower(p_name) AS low, min(p_partkey) AS first FROM (SELECT *, p_type AS label FROM part) GROUP BY ALL),
  m AS (SELECT l.qid, l.ord, l.text, c.low, row_number() OVER (PARTITION BY l.qid, l.ord ORDER BY c.first, c.low) AS rank FROM l JOIN c USING (label) WHERE lower(l.text) <> c.low),
  pools AS (SELECT qid, ord, text, CAST(rank AS INT) AS rank, low AS replacement FROM m WHERE rank <= 5)"""


def candidates(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_type").alias("label"), F.col("p_partkey").alias("cand_ord"), F.col("p_name").alias("cand_text"))


def pools(t: Tables) -> DataFrame:
    return C.candidate_pools(lines(t), candidates(t), [])


def entity_pools(t: Tables) -> DataFrame:
    return C.entity_pools(lines(t), candidates(t), [])


@query(f"{POOLS} SELECT * FROM pools")
def candidate_top5(t: Tables) -> DataFrame:
    return pools(t)


@query(f"WITH {L} SELECT a.qid, a.ord AS first, b.ord AS second FROM l a JOIN l b ON a.qid = b.qid AND a.ord < b.ord")
def combinations(t: Tables) -> DataFrame:
    out = C.combinations(lines(t), 2)
    return out.select("qid", F.col("combo")[0].alias("first"), F.col("combo")[1].alias("second"))


@query(f"""{POOLS}, x AS (SELECT a.qid, a.ord AS first, b.ord AS second, a.replacement AS ra, b.replacement AS rb,
  row_number() OVER (PARTITION BY a.qid ORDER BY a.ord, b.ord, a.rank, b.rank) AS sample FROM pools a JOIN pools b ON a.qid = b.qid AND a.ord < b.ord)
  SELECT qid, CAST(sample AS INT) AS sample, ra, rb FROM x WHERE sample <= 5""")
def cap_g(t: Tables) -> DataFrame:
    questions = t.orders.select(F.col("o_orderkey").alias("qid"), F.lit("").alias("question"))
    out = C.corrupt(questions, lines(t), entity_pools(t), complexity=2).where("complexity = 2")
    return out.select("qid", "sample", F.col("pairs")[0]["replacement"].alias("ra"), F.col("pairs")[1]["replacement"].alias("rb"))


@query(f"""{POOLS}, q AS (SELECT qid, string_agg(text, ' and ' ORDER BY ord) AS question FROM l GROUP BY qid)
  SELECT qid, ord, rank, replace(question, text, replacement) AS corrupted_question FROM pools JOIN q USING (qid)""")
def apply_fold(t: Tables) -> DataFrame:
    q = lines(t).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " and ").alias("question"))
    pair = F.array(F.struct("text", "replacement"))
    return pools(t).join(q, "qid").select("qid", "ord", "rank", C.apply_replacements(F.col("question"), pair).alias("corrupted_question"))


@query(f"""{POOLS} SELECT o_orderkey AS qid, coalesce(p.replacement, o_orderpriority || '?') AS corrupted, p.qid IS NOT NULL AS is_corrupted, CAST(CASE WHEN p.qid IS NULL THEN 0 ELSE 1 END AS INT) AS complexity
  FROM orders LEFT JOIN pools p ON p.qid = o_orderkey AND p.rank = 1""")
def corrupt_explode(t: Tables) -> DataFrame:
    questions = t.orders.select(F.col("o_orderkey").alias("qid"), F.concat("o_orderpriority", F.lit("?")).alias("question"))
    made = pools(t).where("rank = 1").select("qid", F.lit(1).alias("complexity"), F.col("replacement").alias("corrupted_question"))
    return C.with_failures(questions, made).select("qid", F.col("corrupted_question").alias("corrupted"), "is_corrupted", "complexity")


VARIANTS = "v AS (SELECT p_partkey AS qid, p_name AS o, CASE WHEN p_size % 5 = 0 THEN upper(p_name) WHEN p_size % 5 = 1 THEN p_name || chr(10) || 'user' ELSE p_brand END AS c FROM part)"


def variants(t: Tables) -> DataFrame:
    c = F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).when(F.col("p_size") % 5 == 1, F.concat("p_name", F.lit("\nuser"))).otherwise(F.col("p_brand"))
    return t.part.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("original_question"), c.alias("corrupted_question"))


@query(f"WITH {VARIANTS} SELECT qid, c AS corrupted_question FROM v WHERE lower(c) <> lower(o) AND NOT contains(c, chr(10) || 'user')")
def clean_corrupted(t: Tables) -> DataFrame:
    return C.clean_corrupted(variants(t)).select("qid", "corrupted_question")


@query(f"""WITH {VARIANTS}, r AS (SELECT CASE WHEN lower(c) = lower(o) THEN 'u' WHEN contains(c, chr(10) || 'user') THEN 'l' END AS r FROM v)
  SELECT count(*) AS total, count(*) FILTER (WHERE r = 'u') AS unchanged, count(*) FILTER (WHERE r = 'l') AS leaked, count(*) FILTER (WHERE r IS NULL) AS kept FROM r""")
def removal_counts(t: Tables) -> DataFrame:
    return C.removal_counts(variants(t))


@query("SELECT label, count(*) AS n FROM (SELECT p_type AS label FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY label")
def entity_histogram(t: Tables) -> DataFrame:
    from querent.operators.sft import label_histogram

    kinds = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("k")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return label_histogram(kinds.select(F.col("p_type").alias("label"), F.col("k").alias("times")))


@query("""SELECT event_id FROM events WHERE coalesce(value, 0) > CASE event_type WHEN 'click' THEN 5.0 WHEN 'view' THEN 20.0 ELSE 0.75 END""")
def threshold_filter(t: Tables) -> DataFrame:
    limits = t.spark.createDataFrame([("click", 5.0), ("view", 20.0)], "label string, threshold double")
    return C.passes_threshold(t.events, limits, DEFAULT_THRESHOLD, "event_type", "value").select("event_id")


ATTRS = ["part", "page_id"]


@query(f"WITH {L}, k AS (SELECT lower(trim(text)) AS key, arg_max({{'t': text, 'p': part, 'g': page_id}}, {{'q': qid, 'o': ord, 'p': part}}) AS m FROM l GROUP BY 1) SELECT key, m.t AS text, m.p AS part, m.g AS page_id FROM k")
def global_entity_map(t: Tables) -> DataFrame:
    return N.global_entity_map(lines(t), ["qid", "ord", "part"], ATTRS)


def patches(t: Tables) -> DataFrame:
    p = lines(t).select("qid", "page_id", F.col("page_id").alias("page_ord"), F.col("ord").alias("obj_ord"), F.lit(0).alias("ent_ord"), "text", "label")
    return p


@query(f"""WITH {L}, m AS (SELECT a.qid, a.ord, b.page_id AS bp, b.ord AS bo, b.page_id = a.page_id AS own FROM l a JOIN l b ON a.qid = b.qid AND lower(trim(a.text)) = lower(trim(b.text)))
  SELECT qid, ord, string_agg(bp || ':' || bo, ',' ORDER BY bp, bo) AS positions FROM m x
  WHERE own OR NOT EXISTS (SELECT 1 FROM m y WHERE y.qid = x.qid AND y.ord = x.ord AND y.own) GROUP BY qid, ord""")
def entity_positions(t: Tables) -> DataFrame:
    found = N.positions(lines(t), patches(t))
    return found.select("qid", "ord", F.array_join(F.transform("positions", lambda p: F.concat_ws(":", p["on_page"], p["obj_ord"].cast("string"))), ",").alias("positions"))


@query(f"""WITH {L}, f AS (SELECT qid, lower(trim(text)) AS key, arg_min(label, {{'g': page_id, 'o': ord}}) AS label FROM l GROUP BY 1, 2)
  SELECT l.qid, l.ord, coalesce(CASE WHEN l.ord % 2 = 0 THEN l.label END, f.label) AS label FROM l JOIN f ON f.qid = l.qid AND f.key = lower(trim(l.text))""")
def label_backfill(t: Tables) -> DataFrame:
    some = lines(t).withColumn("label", F.when(F.col("ord") % 2 == 0, F.col("label")))
    return N.label_backfill(some, patches(t)).select("qid", "ord", "label")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS qid, l_linenumber AS page, l_returnflag = 'R' AND l_linestatus = 'O' AS h FROM lineitem),
  g AS (SELECT qid, page, bool_or(h) AS hit FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY page) AS i FROM g)
  SELECT DISTINCT a.qid, a.page FROM n a JOIN n b ON a.qid = b.qid AND b.hit AND abs(a.i - b.i) <= 1""")
def adjacent_pages(t: Tables) -> DataFrame:
    hit = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("page_id")).agg(F.max(hit).alias("hit"))
    return V.adjacent_pages(pages).select("qid", F.col("page_id").alias("page"))


@query("""WITH g AS (SELECT l_orderkey AS qid, l_linenumber AS page, bool_or(l_returnflag = 'R') AS yes FROM lineitem GROUP BY ALL)
  SELECT qid, CASE WHEN bool_or(yes) THEN 'true' ELSE 'False' END AS verification_result,
  CAST(coalesce(min(page) FILTER (WHERE yes), max(page)) AS VARCHAR) || '.jpg' AS image_path FROM g GROUP BY qid""")
def any_true_first(t: Tables) -> DataFrame:
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("page_ord")).agg(F.max(F.col("l_returnflag") == "R").alias("answerable"))
    return V.any_page_answers(pages.withColumn("image_path", F.concat(F.col("page_ord").cast("string"), F.lit(".jpg"))))


@query("SELECT doc_id FROM labels WHERE CASE WHEN toxic = 1 THEN 'true' ELSE 'False' END = 'False'")
def false_only(t: Tables) -> DataFrame:
    return V.only_false(t.labels.withColumn("verification_result", F.when(F.col("toxic") == 1, "true").otherwise("False"))).select("doc_id")


@query("SELECT o_orderkey AS qid, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def valid_results(t: Tables) -> DataFrame:
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list(F.struct("l_linenumber")).alias("vqa_results"))
    records = t.orders.select(F.col("o_orderkey").alias("qid"), (F.col("o_orderstatus") != "P").alias("is_corrupted")).join(results, "qid", "left")
    return V.valid_results(records.withColumn("verification_result", F.struct("vqa_results"))).select("qid", F.size("verification_result.vqa_results").cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exclude_used(t: Tables) -> DataFrame:
    from querent.operators.sampling import exclude_used

    return exclude_used(t.orders, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("""WITH RECURSIVE b AS (
    SELECT l_orderkey AS qid, l_linenumber AS ln, l_partkey AS pk, CAST(floor(l_quantity) AS INT) AS x, CAST(l_partkey % 50 AS INT) AS y, CAST(floor(l_quantity) AS INT) + 5 + l_linenumber * 4 AS u,
           CAST(l_partkey % 50 AS INT) + 10 + l_linenumber * 2 AS v FROM lineitem),
  n AS (SELECT *, (u - x) * (v - y) AS area, row_number() OVER (PARTITION BY qid ORDER BY ln, pk, x, y, u, v) AS i FROM b),
  o AS (SELECT qid, [x, y, u, v] AS box, area, row_number() OVER (PARTITION BY qid ORDER BY area DESC, i) AS r FROM n),
  f AS (
    SELECT qid, CAST(1 AS BIGINT) AS r, [box] AS kept FROM o WHERE r = 1
    UNION ALL SELECT f.qid, o.r, CASE WHEN len(list_filter(f.kept, lambda k: greatest(0, least(k[3], o.box[3]) - greatest(k[1], o.box[1])) * greatest(0, least(k[4], o.box[4]) - greatest(k[2], o.box[2])) / o.area >= 0.6)) > 0
      THEN f.kept ELSE list_append(f.kept, o.box) END FROM f JOIN o ON o.qid = f.qid AND o.r = f.r + 1)
  SELECT qid, array_to_string(list_transform(kept, lambda k: array_to_string(k, ',')), ';') AS kept FROM (SELECT qid, arg_max(kept, r) AS kept FROM f GROUP BY qid)""")
def filter_boxes(t: Tables) -> DataFrame:
    x, y = F.floor("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int")
    box = F.array(x, y, (x + 5 + F.col("l_linenumber") * 4), (y + 10 + F.col("l_linenumber") * 2).cast("int"))
    boxes = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", box.alias("b")))).alias("a"))
    kept = F.transform(G.filter_boxes(F.transform("a", lambda v: v["b"])), lambda b: F.array_join(b.cast("array<string>"), ","))
    return boxes.select("qid", F.array_join(kept, ";").alias("kept"))
