"""Quotation linking: quoted passages of messages, the messages they come from, and conversations without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.common import dealt, discard, lookup, materialize, running
from querent.llm.components import components

#: A quoted line: one or more marks, each with blanks before it and at most one after the last.
QUOTE = r"^((?:[\x20\t]*>)+)[\x20\t]?"
#: A line that announces a quote.
ANNOUNCES = r"(?i)^[\x20\t]*(on\x20.{1,200}\x20wrote:|.{1,120}\x20(wrote|writes|said):|-+\x20*original\x20message\x20*-+)[\x20\t]*$"
#: A single line of a quote, and any quote from outside its thread, counts from so many words.
LINE_WORDS, FAR_WORDS = 3, 5


def level(line: Column) -> Column:
    """How deep a line is quoted: the marks of its quote prefix."""
    prefix = F.regexp_extract(line, QUOTE, 1)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))


def normal_form(passage: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def passages(text: Column) -> Column:
    """array<struct<level, body>>: runs of lines of one quote level without a blank line, without their marks,
    in order; announcing lines belong to none and are not passages."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))
    marked = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), ((F.trim(x["body"]) == "") | x["body"].rlike(ANNOUNCES)).alias("gap")))

    def runs(v: Column) -> Column:
        apart = lambda x, y: y.isNull() | y["gap"] | (y["level"] != x["level"])
        places = lambda side: F.filter(F.transform(v, lambda x, i: F.when(~x["gap"] & apart(x, F.get(v, i + side)), i)), lambda i: i.isNotNull())
        body = lambda p: F.array_join(F.transform(F.slice(v, p["b"] + 1, p["e"] - p["b"] + 1), lambda x: x["body"]), "\n")
        return F.transform(F.arrays_zip(places(-1).alias("b"), places(1).alias("e")), lambda p: F.struct(F.get(v, p["b"])["level"].alias("level"), body(p).alias("body")))

    return F.transform(F.array(marked), runs)[0]  # a let: the lines are worked out once


def link(
    messages: DataFrame, thread_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
) -> DataFrame:
    """One row per message: thread, order, clean, n_quotes, n_linked, depth, reply_thread, reply_order, root_thread, root_order, place.

    A passage quoted k levels deep is looked for, by the hash of its normal form, among the passages that
    other messages have unquoted; failing that, its lines of LINE_WORDS words or more are looked for one by one.
    Among several originals the nearest earlier message of the same thread is taken. Without one, a passage of
    FAR_WORDS words or more leads to the first message that has it in another thread, if that is earlier (by
    thread and order) and no third thread has the passage too, so common phrases connect nothing. A message
    replies to the original of its shallowest, then first linked quote; without one, to the message before it
    in its thread. root is what following replies up leads to, place the rank within its conversation in reply
    order (a message after the one it replies to). clean is the text without quotes and the lines that announce
    them; depth the deepest quote level.

    Passages and messages are ordered by ranges, looked up with hot forms apart, and trees are found as
    components, so neither a passage that all quote nor a thread or tree of any size meets in one task.

    Nulls: a null text is empty; rows with a null thread or order are messages of their own that nothing
    links to. Repeated rows (equal thread and order) are one message, of which the least text is kept. An
    empty table gives an empty result; other columns are ignored. Threads are of any type that can be ordered,
    orders are taken as long integers.
    """
    base = messages.select(F.col(thread_col).alias("thread"), F.col(order_col).cast("long").alias("order"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole_rows = base.where(F.col("thread").isNotNull() & F.col("order").isNotNull())
    known = whole_rows.repartitionByRange("thread", "order").groupBy("thread", "order").agg(F.min("text").alias("text"))
    parsed = materialize(known.select("thread", "order", passages(F.col("text")).alias("p"), F.spark_partition_id().alias("_part")), "passages")
    found, used = _linked(parsed)
    per_passage = found.groupBy("thread", "order", "n").agg(F.min(F.struct("line", "level", "to_thread", "to_order")).alias("best"))
    per_message = per_passage.groupBy("thread", "order").agg(
        F.count("*").alias("n_linked"), F.min(F.struct("best.level", "n", "best.to_thread", "best.to_order")).alias("reply"))
    clean = F.array_join(F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["body"]), "\n\n")
    n_quotes = F.size(F.filter("p", lambda x: x["level"] > 0)).cast("long")
    depth = F.coalesce(F.array_max(F.transform("p", lambda x: x["level"])), F.lit(0)).cast("long")
    rows = running(parsed, ["thread"], [F.col("order")], "previous", F.col("order")).select(
        "thread", "order", clean.alias("clean"), n_quotes.alias("n_quotes"), depth.alias("depth"), "previous").join(per_message, ["thread", "order"], "left")
    linked = materialize(rows.select(
        "thread", "order", "clean", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "depth",
        F.when(F.col("reply").isNotNull(), F.col("reply.to_thread")).when(F.col("previous").isNotNull(), F.col("thread")).alias("reply_thread"),
        F.coalesce("reply.to_order", "previous").alias("reply_order"),
    ), "linked")
    discard(parsed, *used)
    rooted = dealt(_roots(linked), ["root_thread", "root_order"], ["thread", "order"], "rooted")
    discard(linked)
    placed = running(rooted, ["root_thread", "root_order"], [F.col("thread"), F.col("order")], "place").withColumn("place", F.col("place") + 1)
    lone = base.where(F.col("thread").isNull() | F.col("order").isNull()).withColumn("p", passages(F.col("text")))
    alone = lone.select(
        "thread", "order", clean.alias("clean"), n_quotes.alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), depth.alias("depth"),
        F.lit(None).cast(base.schema["thread"].dataType).alias("reply_thread"), F.lit(None).cast("long").alias("reply_order"),
        F.col("thread").alias("root_thread"), F.col("order").alias("root_order"), F.lit(1).cast("long").alias("place"))
    return placed.unionByName(alone)


def _linked(parsed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(thread, order, n, line, level, to_thread, to_order) of every quote that has an original; line -1 is the whole
    passage. And the tables behind it."""
    every = parsed.select("thread", "order", F.posexplode("p").alias("n", "x")).select("thread", "order", "n", "x.level", normal_form(F.col("x.body")).alias("form"), F.col("x.body").alias("body"))
    own = every.where("level = 0 and form <> ''")
    lines = own.select("thread", "order", F.explode(F.split("body", "\n")).alias("line")).select("thread", "order", normal_form(F.col("line")).alias("form"))
    originals = own.select("thread", "order", "form").union(lines).where("form <> ''").select("thread", "order", F.xxhash64("form").alias("hash"), "form").distinct()
    quoted = every.where("level > 0 and form <> ''")
    whole = quoted.select("thread", "order", "n", F.lit(-1).alias("line"), "level", "form")
    parts = quoted.select("thread", "order", "n", F.posexplode(F.split("body", "\n")).alias("line", "own"), "level").select("thread", "order", "n", "line", "level", normal_form(F.col("own")).alias("form"))
    words = F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1
    wanted = whole.union(parts.where(F.col("form") != "").where(words >= LINE_WORDS)).withColumn("hash", F.xxhash64("form")).withColumn("far", words >= FAR_WORDS)
    wanted = materialize(wanted, "quoted")
    asked = wanted.groupBy("hash", "form").agg(F.count("*").alias("copies"))
    answers = materialize(originals.join(asked, ["hash", "form"], "left_semi"), "originals")
    first = answers.groupBy("hash", "form").agg(F.min(F.struct("thread", "order")).alias("first"), F.max("thread").alias("last"))
    # originals and quotes of a thread and form in one order
    columns = ["hash", "form", "thread", "order", "n", "line", "level", "far"]
    none = [F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in ("n", "line", "level", "far")]
    both = wanted.select(*columns, F.lit(0).alias("kind")).union(answers.select("hash", "form", "thread", "order", *none, F.lit(1).alias("kind")))
    both = dealt(both, ["hash", "form", "thread"], ["order", "kind"], "both")
    ordered = [F.col("order"), F.col("kind"), F.col("n"), F.col("line")]
    near = running(both, ["hash", "form", "thread"], ordered, "near", F.when(F.col("kind") == 1, F.col("order"))).where("kind = 0")
    far = lookup(near, first, ["hash", "form"], asked)
    may = F.col("far") & (F.col("first.thread") == F.col("last")) & (F.col("first.thread") < F.col("thread"))
    found = far.select(
        "thread", "order", "n", "line", "level", F.when(F.col("near").isNotNull(), F.col("thread")).when(may, F.col("first.thread")).alias("to_thread"),
        F.coalesce("near", F.when(may, F.col("first.order"))).alias("to_order"))
    return found.where("to_order is not null"), [wanted, answers, both]


def _roots(linked: DataFrame) -> DataFrame:
    """linked with root_thread and root_order.

    Replies go to messages that are earlier by thread and order, so the root of a tree is its smallest message,
    and trees are the components of the replies. A thread of which no message replies outside it is one tree
    (or part of one) from its first message on; it stands for one node, and only others are looked at by message.
    """
    away = linked.where(F.col("reply_thread") != F.col("thread"))
    starts = linked.groupBy("thread").agg(F.min("order").alias("start"), F.count("*").alias("copies"))
    torn = away.select("thread", F.lit(True).alias("torn")).distinct()
    threads = materialize(starts.join(torn, "thread", "left").select("thread", "start", F.coalesce("torn", F.lit(False)).alias("torn"), "copies"), "threads")
    known = materialize(lookup(linked, threads.drop("copies"), ["thread"], threads.select("thread", "copies")), "known")
    loose = known.where("torn")
    one = known.where("not torn").withColumn("root_thread", F.col("thread")).withColumn("root_order", F.col("start"))
    if loose.isEmpty():
        return one.drop("start", "torn")
    replies = loose.where("reply_order is not null").select("thread", "order", F.col("reply_thread"), "reply_order")
    targets = threads.select(F.col("thread").alias("reply_thread"), F.col("start").alias("to_start"), F.col("torn").alias("to_torn"))
    edges = lookup(replies, targets, ["reply_thread"]).select(
        F.struct("thread", "order").alias("a"), F.struct(F.col("reply_thread").alias("thread"), F.when(F.col("to_torn"), F.col("reply_order")).otherwise(F.col("to_start")).alias("order")).alias("b"))
    roots = components(edges).select("node.thread", "node.order", F.col("root.thread").alias("root_thread"), F.col("root.order").alias("root_order"))
    rest = loose.join(roots, ["thread", "order"], "left").withColumn("root_thread", F.coalesce("root_thread", "thread")).withColumn("root_order", F.coalesce("root_order", "order"))
    return one.unionByName(rest).drop("start", "torn")


def mailbox(conversations: DataFrame, thread_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """(thread, order, text): the messages of conversations, which quote nobody, as mails that quote each other by a rule.

    A message with an odd order quotes all of the message before it; with an even one its last line, and below
    that, two levels deep, the first line of the thread. The first message of every fifth thread quotes the
    first line of the thread numbered one less. Repeated rows are one message, of which the least text is kept;
    null texts are empty; rows without thread or order are left out.
    """
    t, o = F.col(thread_col), F.col(order_col)
    known = conversations.where(t.isNotNull() & o.isNotNull()).groupBy(t.alias(thread_col), o.alias(order_col)).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("role").alias("role"))
    known = dealt(known, [thread_col], [order_col], "messages")
    mails = materialize(running(known, [thread_col], [o], "before", F.struct(order_col, "role", "text")), "mails")
    first_line = F.split_part(F.min(F.struct(order_col, "text"))["text"], F.lit("\n"), F.lit(1))
    openers = materialize(mails.groupBy(thread_col).agg(first_line.alias("opener")), "openers")
    own = lookup(mails, openers, [thread_col])
    other = openers.select((t + 1).alias(thread_col), F.col("opener").alias("other")).where(t % 5 == 0)
    starts = own.where(F.col("before").isNull()).join(other, thread_col, "left")
    marked = lambda text: F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    said = F.concat(F.lit("On turn "), F.col(f"before.{order_col}").cast("string"), F.lit(", "), F.col("before.role"), F.lit(" wrote:\n"))
    quote = F.when(o % 2 == 1, marked(F.col("before.text"))).otherwise(F.concat(
        F.lit("> "), F.element_at(F.split("before.text", "\n"), -1), F.lit("\n> > "), F.col("opener"), F.lit("\n")))
    replies = own.where(F.col("before").isNotNull()).select(thread_col, order_col, F.concat(said, quote, F.lit("\n"), "text").alias("text"))
    return replies.union(starts.select(thread_col, order_col, F.when(F.col("other").isNull(), F.col("text")).otherwise(F.concat(F.lit("> "), "other", F.lit("\n\n"), "text"))))


def sql(mails: bool = False, thread_col: str = "conv_id", order_col: str = "turn") -> str:
    """link(), or link() of mailbox(), in DuckDB, for rows that have a thread and an order; passages are joined by their normal forms themselves."""
    form = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    made = "m AS (SELECT t, o, text FROM c0)" if not mails else """c1 AS (SELECT *, lag(o) OVER w AS po, lag(role) OVER w AS pr, lag(text) OVER w AS pt, first_value(split_part(text, chr(10), 1)) OVER w AS opener FROM c0 WINDOW w AS (PARTITION BY t ORDER BY o)),
    c2 AS (SELECT t, min(opener) AS opener FROM c1 GROUP BY t),
    m AS (
      SELECT c1.t, c1.o, CASE
        WHEN po IS NULL THEN CASE WHEN c2.opener IS NULL THEN text ELSE '> ' || c2.opener || chr(10) || chr(10) || text END
        WHEN c1.o % 2 = 1 THEN 'On turn ' || po || ', ' || pr || ' wrote:' || chr(10) || '> ' || replace(pt, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text
        ELSE 'On turn ' || po || ', ' || pr || ' wrote:' || chr(10) || '> ' || string_split(pt, chr(10))[-1] || chr(10) || '> > ' || c1.opener || chr(10) || chr(10) || text END AS text
      FROM c1 LEFT JOIN c2 ON c1.po IS NULL AND c1.t % 5 = 0 AND c2.t = c1.t - 1)"""
    return f"""
    WITH RECURSIVE c0 AS (
      SELECT {thread_col} AS t, {order_col} AS o, min(coalesce(text, '')) AS text, min(role) AS role FROM conversations
      WHERE {thread_col} IS NOT NULL AND {order_col} IS NOT NULL GROUP BY ALL),
    {made},
    l0 AS (SELECT t, o, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
    l1 AS (SELECT t, o, i, CASE WHEN ends_with(x, chr(13)) THEN left(x, length(x) - 1) ELSE x END AS x FROM l0),
    l2 AS (SELECT t, o, i, regexp_replace(x, '{QUOTE}', '') AS body, regexp_extract(x, '{QUOTE}', 1) AS p FROM l1),
    l AS (SELECT t, o, i, body, length(p) - length(replace(p, '>', '')) AS level, trim(body) = '' OR regexp_matches(body, '{ANNOUNCES}') AS gap FROM l2),
    b AS (SELECT *, CASE WHEN lag(gap, 1, true) OVER w OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS fresh FROM l WINDOW w AS (PARTITION BY t, o ORDER BY i)),
    r AS (SELECT *, sum(fresh) FILTER (WHERE NOT gap) OVER (PARTITION BY t, o ORDER BY i) AS n FROM b),
    p AS (SELECT t, o, n, min(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM r WHERE NOT gap GROUP BY t, o, n),
    parts AS (
      SELECT t, o, n, level, -1 AS line, {form('body')} AS form FROM p
      UNION ALL SELECT t, o, n, level, i - min(i) OVER (PARTITION BY t, o, n) AS line, {form('body')} AS form FROM r WHERE NOT gap),
    src AS (SELECT DISTINCT t, o, form FROM parts WHERE level = 0 AND form <> ''),
    q AS (SELECT *, length(form) - length(replace(form, ' ', '')) + 1 AS words FROM parts WHERE level > 0 AND form <> '' AND (line < 0 OR length(form) - length(replace(form, ' ', '')) + 1 >= {LINE_WORDS})),
    f AS (
      SELECT q.*, (SELECT max(s.o) FROM src s WHERE s.form = q.form AND s.t = q.t AND s.o < q.o) AS near,
             (SELECT CASE WHEN min(s.t) = max(s.t) AND q.words >= {FAR_WORDS} THEN arg_min({{'t': s.t, 'o': s.o}}, {{'t': s.t, 'o': s.o}}) END FROM src s WHERE s.form = q.form) AS first FROM q),
    g AS (
      SELECT t, o, n, line, level, CASE WHEN near IS NOT NULL THEN t WHEN first.t < t THEN first.t END AS rt,
             CASE WHEN near IS NOT NULL THEN near WHEN first.t < t THEN first.o END AS ro FROM f),
    h AS (SELECT t, o, n, min({{'line': line, 'level': level, 'rt': rt, 'ro': ro}}) AS best FROM g WHERE ro IS NOT NULL GROUP BY ALL),
    k AS (SELECT t, o, count(*) AS n_linked, min({{'level': best.level, 'n': n, 'rt': best.rt, 'ro': best.ro}}) AS reply FROM h GROUP BY ALL),
    a AS (SELECT t, o, string_agg(body, chr(10) || chr(10) ORDER BY n) FILTER (WHERE level = 0) AS clean, count(*) FILTER (WHERE level > 0) AS n_quotes, max(level) AS depth FROM p GROUP BY t, o),
    e AS (
      SELECT m.t, m.o, coalesce(a.clean, '') AS clean, coalesce(a.n_quotes, 0) AS n_quotes, coalesce(k.n_linked, 0) AS n_linked, coalesce(a.depth, 0) AS depth,
             coalesce(reply.rt, CASE WHEN lag(m.o) OVER w IS NOT NULL THEN m.t END) AS rt, coalesce(reply.ro, lag(m.o) OVER w) AS ro
      FROM m LEFT JOIN a USING (t, o) LEFT JOIN k USING (t, o) WINDOW w AS (PARTITION BY m.t ORDER BY m.o)),
    up AS (
      SELECT t, o, t AS at_t, o AS at_o FROM e WHERE ro IS NULL
      UNION ALL SELECT e.t, e.o, up.at_t, up.at_o FROM e JOIN up ON e.rt = up.t AND e.ro = up.o)
    SELECT e.t AS {thread_col}, e.o AS {order_col}, clean, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, CAST(depth AS BIGINT) AS depth,
           rt AS reply_thread, ro AS reply_order, up.at_t AS root_thread, up.at_o AS root_order,
           row_number() OVER (PARTITION BY up.at_t, up.at_o ORDER BY e.t, e.o) AS place
    FROM e JOIN up ON up.t = e.t AND up.o = e.o"""
