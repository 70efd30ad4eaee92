"""Answers, windows, selection and training examples on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions import text as X
from querent.functions import windows as N
from querent.model import UNABLE, UNABLE_PHRASES
from querent.operators import sampling as S
from querent.operators import sft
from querent.plans.registry import Tables, query

ANSWER = """CASE event_type WHEN 'error' THEN 'Not available' WHEN 'signup' THEN '' WHEN 'click' THEN '$' || CAST(event_id % 1000 AS VARCHAR)
  WHEN 'purchase' THEN CAST(event_id % 100 AS VARCHAR) || ',5%' ELSE event_type END"""
NUMERIC = f"""regexp_matches(lower(regexp_replace(regexp_replace(regexp_replace(answer, '[$€,\\s]+', '', 'g'), '%+$', ''), '\\.+$', '')), '{X.NUMBER}')"""
REFUSES = "(lower(answer) = '' OR " + " OR ".join("contains(lower(answer), '" + p.replace("'", "''") + "')" for p in UNABLE_PHRASES) + ")"


def free_text(t: Tables) -> DataFrame:
    e = F.col("event_type")
    answer = (
        F.when(e == "error", "Not available").when(e == "signup", "").when(e == "click", F.concat(F.lit("$"), (F.col("event_id") % 1000).cast("string")))
        .when(e == "purchase", F.concat((F.col("event_id") % 100).cast("string"), F.lit(",5%"))).otherwise(e))
    return t.events.select("event_id", answer.alias("answer"))


@query(f"WITH x AS (SELECT event_id, {ANSWER} AS answer FROM events) SELECT event_id, answer, CASE WHEN {REFUSES} THEN '{UNABLE}' ELSE answer END AS answer_converted FROM x")
def canonicalize(t: Tables) -> DataFrame:
    return X.canonical_answers(free_text(t))


@query(f"WITH x AS (SELECT event_id, {ANSWER} AS answer FROM events) SELECT event_id, {NUMERIC} AS is_numeric FROM x")
def is_numeric(t: Tables) -> DataFrame:
    return free_text(t).select("event_id", X.is_numeric(F.col("answer")).alias("is_numeric"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}_\\s.-]', '', 'g'), ' -') AS clean FROM documents""", name="clean_entity_text")
def clean_entity_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_entity(F.col("text")).alias("clean"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


def cut_after(text: str, marks: str) -> str:
    """SQL: a text divided after each of some characters."""
    return f"string_split(regexp_replace({text}, '([{marks}\\n])', '\\1' || chr(2), 'g'), chr(2))"


#: Sentences end before capitals, digits and opening quotes, of which SQL keeps what it matched.
SENTENCES = r"""unnest(string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+(["''(\[]?[\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)))"""


#: Chunks of sentences s in SQL.
CHUNKS_OF_S = f"""p_ AS (SELECT doc_id, unnest(CASE WHEN length(s) <= 350 THEN [s] WHEN len(list_filter({cut_after('s', ';')}, lambda x: length(x) > 350)) > 0 THEN {cut_after('s', ',;')} ELSE {cut_after('s', ';')} END) AS p FROM s),
  c AS (SELECT doc_id, unnest(CASE WHEN length(p) <= 350 THEN [p] ELSE list_transform(range(CAST(ceil(length(p) / 350.0) AS BIGINT)), lambda k: substr(p, CAST(k * 350 + 1 AS BIGINT), 350)) END) AS c FROM p_)"""


def chunk_sizes(cut: DataFrame) -> DataFrame:
    """Of each row's chunks c their number, and the sums of their lengths and squared lengths."""
    total = lambda f: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + f(F.length(x).cast("long")))
    return cut.select("doc_id", F.size("c").cast("long").alias("n_chunks"), total(lambda n: n).alias("total"), total(lambda n: n * n).alias("squares"))


@query(f"""WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM documents WHERE text IS NOT NULL), {CHUNKS_OF_S}
  SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(c)) AS BIGINT) AS total, CAST(sum(length(c) * length(c)) AS BIGINT) AS squares FROM c GROUP BY doc_id""")
def chunk_text(t: Tables) -> DataFrame:
    return chunk_sizes(t.documents.where("text is not null").select("doc_id", X.chunks(X.sentences(F.col("text"))).alias("c")))


#: What is learnt from all texts about words, in SQL: counts of words, abbreviations, starters, collocations.
BARE = r"""lower(regexp_replace(regexp_replace({0}, '^["''(\[]+', ''), '["'')\],;:]+$', ''))"""
LOGS = "(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


def met_by_chance(both: str, first: str, second: str, n: str) -> str:
    """SQL: twice the log-likelihood ratio of things being met together."""
    logs = lambda k, m, p: LOGS.format(k=f"({k})", n=f"({m})", p=f"(CAST({p} AS DOUBLE))")
    p, p1, p2, rest, others = f"{second} / {n}", f"{both} / {first}", f"({second} - {both}) / ({n} - {first})", f"{second} - {both}", f"{n} - {first}"
    return f"2 * ({logs(both, first, p1)} + {logs(rest, others, p2)} - {logs(both, first, p)} - {logs(rest, others, p)})"


WORDS_SQL = rf"""w AS (SELECT list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
  t0 AS (SELECT ws[i] AS token, CASE WHEN i > 1 THEN ws[i - 1] END AS before FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
  t AS MATERIALIZED (SELECT token, before, regexp_replace({BARE.format('token')}, '\.$', '') AS word, ends_with({BARE.format('token')}, '.') AS dot, regexp_replace(token, '^["''(\[]+', '') AS b FROM t0),
  n AS MATERIALIZED (SELECT word, count(*) FILTER (dot) AS dotted, count(*) FILTER (NOT dot) AS plain, count(*) FILTER (regexp_matches(b, '^\p{{Ll}}')) AS small,
    count(*) FILTER (regexp_matches(b, '^\p{{Lu}}') AND before IS NOT NULL AND NOT regexp_matches(before, '[.!?:]["'')\]]*$')) AS inside FROM t GROUP BY word),
  total AS (SELECT sum(dotted + plain)::DOUBLE AS n, sum(dotted)::DOUBLE AS k FROM n),
  a AS MATERIALIZED (SELECT word, dotted, plain, 2 * ({LOGS.format(k='dotted', n='(dotted + plain)', p='0.99')} - {LOGS.format(k='dotted', n='(dotted + plain)', p='least(total.k / total.n, 0.99)')})
      * exp(-l) * (length(word) - l + 1) * exp(-plain * ln(l::DOUBLE)) AS score
    FROM (SELECT *, length(replace(word, '.', '')) AS l FROM n WHERE dotted > 0 AND regexp_matches(word, '^\p{{L}}+(\.\p{{L}}+)*$')), total)"""


@query(f"WITH {WORDS_SQL} SELECT word, dotted, plain, round(score, 6) AS score FROM a WHERE score >= 0.3")
def abbreviations(t: Tables) -> DataFrame:
    from querent.operators import sentences

    found = sentences.abbreviations(sentences.written(sentences.word_counts(t.documents), "words"))
    return found.select("word", "dotted", "plain", F.round("score", 6).alias("score"))


#: All candidates' pieces of a text with the number of the sentence that they belong to.
SENTENCE_SQL = rf"""{WORDS_SQL},
  stops AS MATERIALIZED (SELECT word, CASE WHEN length(word) = 1 THEN 'initial' ELSE 'abbreviation' END AS kind FROM (
    SELECT word FROM n WHERE dotted > 0 AND regexp_matches(word, '^\p{{L}}$') UNION SELECT word FROM a WHERE score >= 0.3)),
  x AS MATERIALIZED (SELECT regexp_replace(f, '\.$', '') AS first, ends_with(f, '.') AS dot, word, count(*) AS n FROM (
    SELECT {BARE.format('before')} AS f, word FROM t WHERE regexp_matches(before, '[.!?]["'')\]]*$')) GROUP BY ALL),
  y AS MATERIALIZED (SELECT x.*, kind FROM x LEFT JOIN stops ON stops.word = x.first),
  sure AS (SELECT word, sum(n)::DOUBLE AS met FROM y WHERE NOT dot OR (kind IS NULL AND NOT regexp_matches(first, '^[0-9]+$')) GROUP BY word),
  breaks AS (SELECT sum(met) AS breaks FROM sure),
  starters AS MATERIALIZED (SELECT word FROM (SELECT word, met, breaks, (dotted + plain)::DOUBLE AS a, total.n AS n FROM sure JOIN n USING (word), total, breaks
    WHERE regexp_matches(word, '^\p{{L}}+(\.\p{{L}}+)*$') AND met / breaks > a / total.n) WHERE {met_by_chance('met', 'breaks', 'a', 'n')} >= 30),
  near AS (SELECT y.first, y.word, sum(y.n)::DOUBLE AS met FROM y WHERE dot AND (kind IS NOT NULL OR regexp_matches(first, '^[0-9]+$')) GROUP BY ALL HAVING sum(y.n) > 1),
  collocations AS MATERIALIZED (SELECT first, word FROM (SELECT near.first, near.word, met, f.dotted::DOUBLE AS fs, (s.dotted + s.plain)::DOUBLE AS a, total.n AS n
    FROM near JOIN n f ON f.word = near.first JOIN n s ON s.word = near.word, total WHERE near.word NOT IN (SELECT word FROM starters) AND met / fs > a / total.n)
    WHERE {met_by_chance('met', 'fs', 'a', 'n')} >= 7.88),
  p AS MATERIALIZED (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]]*\s+)(["''(\[]?[\p{{Lu}}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
  q AS (SELECT doc_id, i, ps[i] AS piece, len(list_filter(string_split_regex(ps[i], '[ \t\n\r\f]+'), lambda x: x <> '')) AS words, CASE WHEN i > 1 THEN {BARE.format(r"regexp_extract(ps[i - 1], '(\S+)\s*$', 1)")} END AS l,
    regexp_extract(ps[i], '^(\S+)', 1) AS nx FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
  r AS (SELECT doc_id, i, piece, words, nx, CASE WHEN ends_with(l, '.') THEN regexp_replace(l, '\.$', '') END AS f, regexp_replace({BARE.format('nx')}, '\.$', '') AS s FROM q),
  j AS (SELECT r.doc_id, r.i, r.piece, r.words, CASE WHEN r.i = 1 THEN 0 WHEN c.first IS NOT NULL THEN 0 WHEN k.kind IS NULL THEN 1 WHEN st.word IS NOT NULL THEN 1
      WHEN k.kind = 'abbreviation' AND m.small > 0 AND m.inside = 0 AND regexp_matches(regexp_replace(r.nx, '^["''(\[]+', ''), '^\p{{Lu}}') THEN 1 ELSE 0 END AS ok
    FROM r LEFT JOIN stops k ON k.word = r.f LEFT JOIN starters st ON st.word = r.s LEFT JOIN collocations c ON c.first = r.f AND c.word = r.s LEFT JOIN n m ON m.word = r.s),
  o AS (SELECT doc_id, i, piece, words, sum(ok) OVER (PARTITION BY doc_id ORDER BY i) AS sentence FROM j)"""


@query(rf"""WITH {SENTENCE_SQL}
  SELECT doc_id, count(*) AS n_sentences, CAST(sum(words * words) AS BIGINT) AS squares FROM (SELECT doc_id, sentence, sum(words) AS words FROM o GROUP BY ALL) GROUP BY doc_id""")
def sentence_boundaries(t: Tables) -> DataFrame:
    """Sentences of all texts by a model that all texts gave, and the sum of their squared numbers of words."""
    from querent.operators import sentences

    cut = sentences.split(t.documents.where("text is not null").select("doc_id", "text"), sentences.learn(t.documents))
    words = F.transform("sentences", lambda s: F.size(F.array_remove(F.split(s, sentences.BLANK, -1), "")).cast("long"))
    return cut.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.aggregate(words, F.lit(0).cast("long"), lambda a, n: a + n * n).alias("squares"))


@query(rf"""WITH {SENTENCE_SQL},
  s0 AS (SELECT doc_id, sentence, string_agg(piece, '' ORDER BY i) AS s FROM o GROUP BY ALL),
  s AS (SELECT doc_id, CASE WHEN sentence = max(sentence) OVER (PARTITION BY doc_id) THEN s ELSE regexp_replace(s, '\s+$', '') END AS s FROM s0),
  {CHUNKS_OF_S}
  SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(c)) AS BIGINT) AS total, CAST(sum(length(c) * length(c)) AS BIGINT) AS squares FROM c GROUP BY doc_id""")
def sentence_chunks(t: Tables) -> DataFrame:
    """Chunks of the sentences that the model of all texts gives."""
    from querent.operators import sentences

    cut = sentences.split(t.documents.where("text is not null").select("doc_id", "text"), sentences.learn(t.documents))
    return chunk_sizes(cut.select("doc_id", X.chunks(F.col("sentences")).alias("c")))


@query(r"SELECT lang, count(*) AS n, true AS good FROM documents WHERE lang IS NOT NULL AND regexp_matches(text, '\p{L}') GROUP BY lang")
def detected_languages(t: Tables) -> DataFrame:
    """Of each language its documents with letters, and whether profiles of four fifths of them tell 95 % of all right."""
    from querent.operators import language

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    profiles = language.fit(t.documents.where(~held))
    found = t.documents.where("lang is not null").select("lang", language.detector(profiles)("text").alias("found")).where("found is not null")
    return found.groupBy("lang").agg(F.count("*").alias("n"), (F.count_if(F.col("found") == F.col("lang")) >= 0.95 * F.count("*")).alias("good"))


def paged(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    return lines.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"].cast("string")).alias("pages"))


PAGES = """l AS (SELECT l_orderkey AS qid, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
  d AS (SELECT qid, list(CAST(p AS VARCHAR) ORDER BY n) AS pages, count(*) AS k FROM l GROUP BY qid)"""


@query(f"""WITH {PAGES}, s AS (SELECT DISTINCT qid, pages, least(i, greatest(k - 3, 0)) AS s FROM d, LATERAL (SELECT unnest(range(k)) AS i) WHERE k > 3 OR i = 0)
  SELECT qid, array_to_string(pages[CAST(s + 1 AS BIGINT):CAST(s + 3 AS BIGINT)], ',') AS pages FROM s""")
def sliding_windows(t: Tables) -> DataFrame:
    return paged(t).select("qid", F.explode(N.sliding_windows(F.col("pages"), 3)).alias("w")).select("qid", F.array_join("w", ",").alias("pages"))


@query(f"WITH {PAGES} SELECT qid, array_to_string(pages[CAST(i + 1 AS BIGINT):CAST(i + 2 AS BIGINT)], ',') AS pages FROM d, LATERAL (SELECT unnest(range(0, k, 2)) AS i)")
def tumbling_windows(t: Tables) -> DataFrame:
    return paged(t).select("qid", F.explode(N.tumbling_windows(F.col("pages"), 2)).alias("w")).select("qid", F.array_join("w", ",").alias("pages"))


@query(f"""WITH {PAGES}, a AS (SELECT *, coalesce(list_position(pages, CAST(qid % 200 AS VARCHAR)), 1) - 1 AS pos FROM d), s AS (SELECT *, greatest(0, least(pos - 1, k - 3)) AS s FROM a)
  SELECT qid, array_to_string(pages[CAST(s + 1 AS BIGINT):CAST(s + 3 AS BIGINT)], ',') AS pages FROM s""")
def anchor_window(t: Tables) -> DataFrame:
    w = N.anchor_window(F.col("pages"), (F.col("qid") % 200).cast("string"), 3)
    return paged(t).select("qid", F.array_join(w, ",").alias("pages"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS calls FROM events""")
def rate_window(t: Tables) -> DataFrame:
    from querent.streaming.incremental import calls_in_window

    return calls_in_window(t.events, "ts", 3600, ["user_id"]).select("event_id", "calls")


@query("""SELECT l_orderkey AS qid, string_agg(t, chr(10) ORDER BY y, x, t) AS ocr FROM
  (SELECT l_orderkey, CAST(floor(l_quantity) AS INT) % 7 AS y, l_linenumber AS x, p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def reading_order(t: Tables) -> DataFrame:
    y = F.floor("l_quantity").cast("int") % 7
    objects = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", F.struct(F.array(F.col("l_linenumber"), y).alias("BBOX"), F.col("p_name").alias("OCR")).alias("o"))
    return objects.groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list("o").alias("o")).select("qid", N.reading_order(F.col("o")).alias("ocr"))


TYPED = """t AS (SELECT o_orderkey AS qid, CAST(o_orderkey % 3 + 1 AS INT) AS complexity, list_sort(list_distinct(list(p_type))) AS types FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def typed(t: Tables) -> DataFrame:
    kinds = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_set("p_type").alias("types"))
    return kinds.join(t.orders.select(F.col("o_orderkey").alias("qid")), "qid").select("qid", (F.col("qid") % 3 + 1).cast("int").alias("complexity"), "types")


# questions of one complexity and set of types rank all others alike, so SQL ranks by kinds as well: three of each suffice for two
@query(f"""WITH {TYPED}, p AS (SELECT *, row_number() OVER (PARTITION BY complexity, types ORDER BY qid) AS r FROM t), k AS (SELECT DISTINCT complexity, types FROM t),
  x AS (SELECT k.complexity, k.types, p.qid AS pool_id, k.complexity = p.complexity AS same_complexity,
    CAST(len(list_intersect(k.types, p.types)) AS DOUBLE) / len(list_distinct(list_concat(k.types, p.types))) AS jaccard FROM k, p WHERE p.r <= 3),
  y AS (SELECT *, row_number() OVER (PARTITION BY complexity, types ORDER BY same_complexity DESC, jaccard DESC, pool_id) AS r FROM x),
  z AS (SELECT t.qid, pool_id, same_complexity, jaccard, row_number() OVER (PARTITION BY t.qid ORDER BY same_complexity DESC, jaccard DESC, pool_id) AS rank FROM t JOIN y USING (complexity, types) WHERE r <= 3 AND pool_id <> t.qid)
  SELECT qid, pool_id, same_complexity, jaccard, CAST(rank AS INT) AS rank FROM z WHERE rank <= 2""")
def few_shot_specific(t: Tables) -> DataFrame:
    own = typed(t)
    return S.few_shot_specific(own, own.withColumn("pool_ord", F.col("qid")), 2)


HASH = "md5('42:' || o_orderkey)"


@query(f"SELECT o_orderkey AS qid FROM orders ORDER BY {HASH} LIMIT 8")
def few_shot_random(t: Tables) -> DataFrame:
    return S.sample_range(t.orders.select(F.col("o_orderkey").alias("qid")), "qid", 8)


@query(f"SELECT o_orderkey AS qid FROM orders ORDER BY {HASH} LIMIT (SELECT CAST(floor(count(*) * 12.5 / 100) AS BIGINT) FROM orders)")
def sample_pct(t: Tables) -> DataFrame:
    return S.sample_percent(t.orders.select(F.col("o_orderkey").alias("qid")), "qid", 12.5)


@query("""WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, '<image>' || chr(10) || text AS input, a AS output FROM x WHERE role = 'user' AND r = 'assistant'""")
def clean_sft(t: Tables) -> DataFrame:
    pairs = sft.next_answers(t.conversations)
    made = pairs.withColumn("e", sft.example("", F.col("question"), F.col("answer"), F.lit("page.png")))
    return made.select("conv_id", "turn", "e.input", "e.output")


@query("""SELECT p_partkey, 'Unable to determine. The term ''' || p_name || ''' refers to a corrupted entity not present as a data point in this context.' AS output FROM part""")
def refusal_sft(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", sft.refusal(F.col("p_name")).alias("output"))


@query("""SELECT o_orderpriority AS dataset, count(*) FILTER (WHERE o_orderstatus = 'F') AS clean, count(*) FILTER (WHERE o_orderstatus <> 'F') AS corrupted, count(*) AS total,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS share, count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(*) AS clean_share FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def sft_recap(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "clean").otherwise("corrupted")
    return sft.recap(t.orders.select(F.col("o_orderpriority").alias("dataset"), kind.alias("kind")))


@query("""SELECT vec_id, label FROM (SELECT q.vec_id, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY avg(list_cosine_similarity(q.embedding, c.embedding)) DESC, c.label) AS r
  FROM embeddings q, embeddings c GROUP BY q.vec_id, c.label) WHERE r = 1""")
def cosine_classify(t: Tables) -> DataFrame:
    from querent.operators.models import nearest_category

    return nearest_category(t.embeddings, t.embeddings, "vec_id", "embedding", "label")


@query("SELECT user_id, CAST(greatest(0, user_id - 1) AS BIGINT) AS page, event_type AS answer FROM events")
def page_zero_based(t: Tables) -> DataFrame:
    from querent.operators.standardize import zero_based

    return t.events.select("user_id", zero_based(F.col("user_id")).cast("long").alias("page"), F.col("event_type").alias("answer"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS questionId, o_orderpriority AS question, CAST(o_orderkey % 3 AS INT) AS answer_page_idx, CAST(count(*) AS BIGINT) AS n_answers
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def standardize_pages(t: Tables) -> DataFrame:
    from querent.operators.standardize import standardize_located

    found = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("answers"))
    raw = t.orders.join(found, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("questionId"), F.col("o_orderpriority").alias("question"), "answers", F.col("o_orderstatus").alias("data_split"),
        F.lit("d").alias("docId"), F.array(F.lit("p")).alias("document"), F.struct(F.array((F.col("o_orderkey") % 3).cast("int")).alias("page"), F.array(F.lit(1)).alias("left")).alias("bbox"))
    return standardize_located(raw, "F").select("questionId", "question", "answer_page_idx", F.size("answers").cast("long").alias("n_answers"))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def stream_exact_n(t: Tables) -> DataFrame:
    from querent.streaming.incremental import verified_until

    source = t.spark.readStream.schema(t.orders.schema).parquet(f"{t.sf_dir}/orders.parquet*")
    return verified_until(source, lambda df: df.where("o_orderstatus = 'F'"), "o_orderkey", 500)
