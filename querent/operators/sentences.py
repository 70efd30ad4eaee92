"""Sentence boundaries without labelled text: abbreviations, collocations and sentence starters are learnt from counts.

A full stop that closes an abbreviation rarely ends a sentence. Which words are abbreviations shows in how often they
come with a full stop, compared by log-likelihood with how often any word does, weighted for short words, full stops
inside and occurrences without one. Words that follow sure ends far more often than others begin sentences, and
pairs across a full stop that are met far more often than by chance belong together. Counting is groupBy on words and
pairs; cutting is expressions on the texts, with each text's doubtful places looked up in the tables.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.streaming.incremental import written

#: Limits of the scores: abbreviations, sentence starters, collocations; and the share of full stops that an
#: abbreviation is taken to have.
ABBREVIATION, STARTER, COLLOCATION, SURE = 0.3, 30.0, 7.88, 0.99
#: Tables of up to so many rows, which are counted, are broadcast.
BROADCAST_ROWS = 200_000

#: Marks that can end a sentence, what may close a token after one, and what the pattern \s takes for white space.
ENDS, CLOSES, SPACES = ".!?", "\"')]", " \t\n\x0b\f\r"
#: What opens and closes a token beside the word itself, a word with full stops inside, and white space.
OPENING, CLOSING, WORD, BLANK = "\"'([", "\"')],;:", r"^\p{L}+(\.\p{L}+)*$", r"[ \t\n\r\f]+"


def bare(token: Column) -> Column:
    """A token in lower case without what opens and closes it."""
    return F.lower(F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING)))


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, before, follows, n): how often each token of the texts comes, after each token that can end a sentence (else
    `before` is null), and whether it follows another token within a sentence. Patterns look at these rows only, not
    at each token of the texts."""
    words = df.where(F.col(text).isNotNull()).select(F.split(text, BLANK, -1).alias("w"))
    one = words.select("w", F.posexplode("w").alias("i", "token")).where("token <> ''").select("token", F.get("w", F.col("i") - 1).alias("last"))
    has = lambda c, marks: functools.reduce(Column.__or__, (F.endswith(c, F.lit(m)) for m in marks))
    one = one.withColumn("open", F.when(has("last", CLOSES), F.rtrim("last", F.lit(CLOSES))).otherwise(F.col("last")))
    follows = F.coalesce((F.col("last") != "") & ~has("open", ENDS + ":"), F.lit(False))
    return one.select("token", F.when(has("open", ENDS), F.col("last")).alias("before"), follows.alias("follows")).groupBy("token", "before", "follows").agg(F.count("*").alias("n"))


def plain(low: Column) -> Column:
    """A bare token without its last full stop."""
    return F.when(F.endswith(low, F.lit(".")), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def capital(token: Column) -> Column:
    return F.ltrim(token, F.lit(OPENING)).rlike(r"^\p{Lu}")


def small_letter(token: Column) -> Column:
    return F.ltrim(token, F.lit(OPENING)).rlike(r"^\p{Ll}")


def log_odds(k: Column, n: Column, p: Column) -> Column:
    """The logarithm of the chance of k hits in n trials, but for the binomial coefficient; 0 times its logarithm is 0."""
    part = lambda x, y: F.when(x > 0, x * F.log(y)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def surprise(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of `second` of n things being met `both` times among `first` of them."""
    p, p1, p2 = second / n, both / first, (second - both) / (n - first)
    return 2 * (log_odds(both, first, p1) + log_odds(second - both, n - first, p2) - log_odds(both, first, p) - log_odds(second - both, n - first, p))


@dataclass
class Model:
    """What is known of words: (word, kind) of abbreviations and initials, of starters, and of words whose capital
    marks a sentence's begin; (first, second) of collocations. All are tables, so they may be of any size."""

    stops: DataFrame
    starters: DataFrame
    capitals: DataFrame
    collocations: DataFrame


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, dotted, plain, small, inside): how often each word comes with and without a full stop, in small letters, and
    with a capital inside a sentence."""
    return words_of(token_counts(df, text))


def words_of(counted: DataFrame) -> DataFrame:
    """word_counts() of the rows of token_counts()."""
    low = bare(F.col("token"))
    t = counted.select(low.alias("low"), "n", "follows", capital(F.col("token")).alias("capital"), small_letter(F.col("token")).alias("small"))
    t = t.select(plain(F.col("low")).alias("word"), F.endswith("low", F.lit(".")).alias("dot"), "n", "small", (F.col("capital") & F.col("follows")).alias("within"))
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return t.groupBy("word").agg(of(F.col("dot")).alias("dotted"), of(~F.col("dot")).alias("plain"), of(F.col("small")).alias("small"), of(F.col("within")).alias("inside"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(word, dotted, plain, score) of the words of word_counts() that are taken for abbreviations."""
    total = counts.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n"), F.sum("dotted").alias("k")).first()
    if not total["k"]:
        return counts.select("word", "dotted", "plain", F.lit(0.0).alias("score")).where("false")
    k, n = F.col("dotted"), F.col("dotted") + F.col("plain")
    ratio = 2 * (log_odds(k, n, F.lit(SURE)) - log_odds(k, n, F.lit(min(total["k"] / total["n"], SURE))))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    # many occurrences without a full stop make the weight too small for a double: then the score is zero
    score = ratio * F.exp(-letters.cast("double")) * (F.length("word") - letters + 1) * F.exp(-F.col("plain") * F.log(letters.cast("double")))
    return counts.where(F.col("word").rlike(WORD) & (F.col("dotted") > 0)).withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("word", "dotted", "plain", "score")


def learn(df: DataFrame, text: str = "text") -> Model:
    """The model of all texts. Null and empty texts have no words; repeated texts count as often as they occur; of an empty
    table nothing is known, and every candidate is a boundary."""
    counted = written(token_counts(df, text), "tokens")
    counts = written(words_of(counted), "words")
    total = counts.agg(F.sum(F.col("dotted") + F.col("plain"))).first()[0] or 0
    stops = counts.where(F.col("word").rlike(r"^\p{L}$") & (F.col("dotted") > 0)).select("word", F.lit("initial").alias("kind"))
    found = abbreviations(counts).select("word", F.lit("abbreviation").alias("kind"))
    stops = written(stops.union(found.join(stops, "word", "left_anti")), "stops")
    capitals = counts.where("small > 0 and inside = 0").select("word")
    # pairs across a mark that can end a sentence
    across = counted.where(F.col("before").isNotNull()).select(bare(F.col("before")).alias("b"), bare(F.col("token")).alias("low"), "n")
    pairs = across.select("b", plain(F.col("low")).alias("word"), "n").groupBy("b", "word").agg(F.sum("n").alias("n"))
    pairs = written(pairs.select(plain(F.col("b")).alias("first"), F.endswith("b", F.lit(".")).alias("dot"), "word", "n"), "pairs")
    known = few(stops.select(F.col("word").alias("first"), "kind"))
    pairs = pairs.join(known, "first", "left")
    number = F.col("first").rlike(r"^[0-9]+$")
    sure = written(pairs.where(~F.col("dot") | (F.col("kind").isNull() & ~number)).groupBy("word").agg(F.sum("n").alias("both")), "sure")
    breaks = sure.agg(F.sum("both")).first()[0] or 0
    every = counts.select("word", (F.col("dotted") + F.col("plain")).alias("all_"))
    starts = sure.join(every, "word").where(F.col("word").rlike(WORD) & (F.col("both") / F.lit(max(breaks, 1)) > F.col("all_") / F.lit(max(total, 1))))
    starters = starts.where(surprise(F.col("both"), F.lit(breaks), F.col("all_"), F.lit(total)) >= STARTER).select("word") if breaks else starts.select("word").where("false")
    starters = written(starters, "starters")
    near = pairs.where(F.col("dot") & (F.col("kind").isNotNull() | number)).groupBy("first", "word").agg(F.sum("n").alias("both")).where("both > 1")
    dotted = counts.select(F.col("word").alias("first"), F.col("dotted").alias("firsts"))
    near = near.join(dotted, "first").join(every, "word").join(few(starters), "word", "left_anti").where("both / firsts > all_ / " + str(max(total, 1)))
    found = near.where(surprise(F.col("both"), F.col("firsts"), F.col("all_"), F.lit(total)) >= COLLOCATION)
    return Model(stops, starters, capitals, written(found.select("first", F.col("word").alias("second")), "collocations"))


def inside(places: DataFrame, model: Model) -> DataFrame:
    """Of places (…, last, next: the tokens on both sides of a candidate) those where no sentence ends."""
    p = places.withColumns({"_first": bare(F.col("last")), "_second": bare(F.col("next"))}).where(F.endswith("_first", F.lit(".")))
    p = p.withColumns({c: plain(F.col(c)) for c in ("_first", "_second")})
    stops = few(model.stops.select(F.col("word").alias("_first"), F.col("kind").alias("_kind")))
    pairs = few(model.collocations.select(F.col("first").alias("_first"), F.col("second").alias("_second"), F.lit(True).alias("_pair")))
    p = p.join(stops, "_first", "left").join(pairs, ["_first", "_second"], "left").where("_pair OR _kind IS NOT NULL")
    starters = few(model.starters.select(F.col("word").alias("_second"), F.lit(True).alias("_starts")))
    p = p.join(starters, "_second", "left").where("_pair OR _starts IS NULL")
    # only places after an abbreviation need to know more of the next word; a word has no blank, so others find nothing
    asks = F.col("_pair").isNull() & (F.col("_kind") == "abbreviation") & capital(F.col("next"))
    p = p.withColumn("_ask", F.when(asks, F.col("_second")).otherwise(F.concat(F.lit(" "), "_first", F.lit(" "), "_second")))
    return p.join(model.capitals.select(F.col("word").alias("_ask")), "_ask", "left_anti").select(places.columns)


def split(df: DataFrame, model: Model, text: str = "text", into: str = "sentences") -> DataFrame:
    """df with its texts' sentences as array<string>: cut at the candidates of functions.text.sentences() that the model
    doesn't take for the inside of a sentence, whose white space stays as it is. Null texts have null.

    Only the places inside sentences come back to the texts, by the text's hash: they are few."""
    key = F.md5(F.col(text))
    several = df.where(F.col(text).isNotNull()).select(key.alias("_key"), pieces_of(text).alias("_p"))
    one = several.select("_key", "_p", F.posexplode("_p").alias("i", "next")).where("i > 0")
    before = F.get("_p", F.col("i") - 1)
    # the last token is looked for from the end, as a search from the begin would try each place of the piece
    places = one.select("_key", (F.col("i") - 1).alias("i"), F.reverse(F.regexp_extract(F.reverse(before), r"^\s*(\S+)", 1)).alias("last"), F.regexp_extract("next", r"^(\S+)", 1).alias("next"))
    found = written(inside(places, model).groupBy("_key").agg(F.collect_set("i").alias("_in")), "inside")  # of one text
    met = df.withColumn("_key", key).join(found, "_key", "left").withColumn("_p", pieces_of(text))
    # the pieces that end a sentence, counted from 0
    ends = F.array_except(F.sequence(F.lit(0), F.size("_p") - 1), F.coalesce("_in", F.array().cast("array<int>")))

    def sentence(end: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.get("_ends", i - 1) + 1).otherwise(0)
        whole = F.array_join(F.slice("_p", begin + 1, end - begin + 1), "")
        return F.when(end < F.size("_p") - 1, F.rtrim(whole, F.lit(SPACES))).otherwise(whole)

    cut = met.withColumn("_ends", F.when(F.col("_p").isNotNull(), ends)).withColumn(into, F.transform("_ends", sentence))
    return cut.drop("_key", "_in", "_p", "_ends")


def pieces_of(column: str) -> Column:
    """The candidates of a text with the white space that follows them."""
    return F.split(F.regexp_replace(column, r"""([.!?]["')\]]*)(\s+)(?=["'(\[]?[\p{Lu}0-9])""", "$1$2\u0001"), "\u0001", -1)
