"""License scans by a positional index of rare words.

Each text is brought to the places of the words that licences have. Sentences are looked up by the two words of
their mandatory phrase that are rarest over the corpus: their places less their places in the phrase are
intersected, and the phrase is verified there. Whole licences are looked up by their rarest words: each place of
one votes for where the licence would begin, and where enough of them agree, up to some words more or less
between them, the mandatory phrase and the share of the licence's words that stand in their places decide. So
a licence is found with words changed, left out or put in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.common import materialize

#: What separates words: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only letter beyond ASCII whose lower case is an ASCII letter, and a letter to stand in for it.
KELVIN, STAND_IN = "K", "ķ"


@dataclass(frozen=True)
class Template:
    """A licence sentence or text; phrase is its mandatory part, which begins at word `at` of it."""

    label: str
    sentence: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.sentence.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split(" ")

    @property
    def at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


#: Labels, licence sentences and mandatory phrases. Each label of the base has one phrase.
TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
)


#: Rare words by which a whole licence is looked up, how many of them have to agree on where it begins, by how many
#: words they may differ, and the share of the licence's words that has to stand in its place up to that.
ANCHORS, LEAST_VOTES, SHIFT, LEAST_SHARE = 12, 4, 10, 0.6

#: Licence texts and notices, lower-cased and without marks, and their mandatory phrases.
LICENCES = (
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in
the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of
contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""", "free of charge to any person obtaining a copy"),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and
this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or
profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""", "with or without fee is hereby granted"),
    Template("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of
source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and
contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
             "following conditions are met"),
    Template("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
             "unless required by applicable law or agreed to in writing"),
    Template("gpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied
warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""", "either version 3 of the license"),
    Template("gpl-2", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied
warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""", "either version 2 of the license"),
    Template("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http
mozilla org mpl 2 0""", "mozilla public license v 2 0"),
    Template("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in
source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this
software dedicate any and all copyright interest in the software to the public domain""", "released into the public domain"),
    Template("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this
software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software""", "must not claim that you wrote the original software"),
)


def normalized(text: Column) -> Column:
    """A-Z lower-cased, words joined by single spaces. (lower() changes other letters too, but none to ASCII.)"""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def word_places(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, hits): of each text, how many words it has and where the given ones stand, array<struct<w, i>> by place."""
    parts = F.split("norm_", " ")
    n_words = F.when(F.col("norm_") == "", F.lit(0)).otherwise(F.size(parts)).cast("long")
    place = lambda x, i: F.when(x.isin(words), F.struct(x.alias("w"), i.alias("i")))
    hits = F.filter(F.transform(parts, place), lambda h: h.isNotNull())
    return docs.select(id_col, normalized(F.col(text_col)).alias("norm_")).select(id_col, n_words.alias("n_words"), hits.alias("hits"))


def document_frequencies(places: DataFrame) -> dict[str, int]:
    """In how many documents of word_places() each word stands; a row a word, of a fixed vocabulary, reaches the driver."""
    own = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    return {r["w"]: r["n"] for r in places.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def _rare(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The two words of the phrase with the highest inverse document frequency, and their places in it."""
    order = sorted(range(len(template.key)), key=lambda i: (df.get(template.key[i], 0), -len(template.key[i]), i))
    second = next((i for i in order if template.key[i] != template.key[order[0]]), order[0])
    return [(template.key[i], i) for i in (order[0], second)]


def _anchors(licence: Template, df: dict[str, int]) -> list[str]:
    """The ANCHORS words of a licence with the highest inverse document frequency, rarest first."""
    words = licence.words
    return sorted(set(words), key=lambda w: (df.get(w, 0), -len(w), words.index(w)))[:ANCHORS]


def licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
    licences: tuple[Template, ...] = LICENCES,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest start
    (null without any). labels also has those of whole licences. score is the largest share of a found
    sentence that stands around its phrase, or of a found licence's words that stand in their places. Which words
    serve for the lookup of sentences has no bearing on the result. Null and empty texts have no words and labels;
    repeated rows have equal results; an empty table gives an empty result; other columns aren't read.

    Texts are read once: the places of licence words are written, counted, and looked up.
    """
    vocabulary = sorted({w for t in (*templates, *licences) for w in t.words})
    places = materialize(word_places(docs, vocabulary, id_col, text_col), "places")
    df = document_frequencies(places)
    rare = {t.label: _rare(t, df) for t in templates}
    anchors = {t.label: _anchors(t, df) for t in licences}
    # of a licence's anchors LEAST_VOTES have to stand in a text, so one of all but LEAST_VOTES - 1 of them does
    firsts = sorted({pair[0][0] for pair in rare.values()} | {w for own in anchors.values() for w in own[: len(own) - LEAST_VOTES + 1]})
    known = F.transform("hits", lambda h: h["w"])
    may = F.arrays_overlap(known, F.split(F.lit(" ".join(firsts)), " "))
    none = F.array().cast(places.schema["hits"].dataType)
    staged = places.select(id_col, "n_words", F.when(may, F.col("hits")).otherwise(none).alias("hits_"))
    looked = sorted({w for pair in rare.values() for w, _ in pair} | {w for own in anchors.values() for w in own})
    staged = staged.withColumn("rare_", F.filter("hits_", lambda h: h["w"].isin(looked)))

    # expressions as SQL text, which is parsed at once: a licence has hundreds of parts
    constant = lambda words: f"split('{' '.join(words)}', ' ')"

    def stands(s: str, words: list[str]) -> str:
        """Whether words stand one after the other from a place on."""
        here = f"filter(hits_, g -> g.i >= {s} AND g.i < {s} + {len(words)})"
        return f"(size({here}) = {len(words)} AND transform({here}, g -> g.w) = {constant(words)})"

    def starts(t: Template) -> str:
        at = lambda w, p: f"transform(filter(rare_, h -> h.w = '{w}'), h -> h.i - {p})"
        a, b = rare[t.label]
        return f"filter(array_intersect({at(*a)}, {at(*b)}), s -> s >= 0 AND {stands('s', t.key)})"

    def share(t: Template) -> str:
        """Of each start, how many words of the sentence stand in their places."""
        fit = f"size(filter({constant(t.words)}, (x, k) -> exists(hits_, g -> g.i = s + k - {t.at} AND g.w = x))) / {len(t.words)}"
        return f"array_max(transform(`at_{t.label}`, s -> {fit}))"

    def votes(t: Template) -> str:
        """array<struct<o, w>>: where the licence would begin by each place of one of its anchors."""
        posts = ", ".join(f"named_struct('w', '{w}', 'p', {p})" for w in anchors[t.label] for p, x in enumerate(t.words) if x == w)
        own = ", ".join(f"'{w}'" for w in anchors[t.label])
        return f"flatten(transform(filter(rare_, h -> h.w IN ({own})), h -> transform(filter(array({posts}), p -> p.w = h.w), p -> named_struct('o', h.i - p.p, 'w', h.w))))"

    def whole(t: Template) -> str:
        """The largest share of the licence's words that stand in their places from a beginning that the votes give; or null."""
        v, n = f"`votes_{t.label}`", len(t.words)
        agreed = f"size(array_distinct(transform(filter({v}, x -> abs(x.o - o) <= {SHIFT}), x -> x.w))) >= {LEAST_VOTES}"
        has_key = f"exists(sequence(o + {t.at - SHIFT}, o + {t.at + SHIFT}), s -> {stands('s', t.key)})"
        window = f"array(filter(hits_, h -> h.i >= o - {SHIFT} AND h.i <= o + {n + SHIFT}))"  # a let: filtered once
        covered = f"transform({window}, near -> size(filter({constant(t.words)}, (x, k) -> exists(near, h -> abs(h.i - k - o) <= {SHIFT} AND h.w = x))))[0] / {n}"
        best = f"array_max(filter(transform(filter(array_distinct(transform({v}, x -> x.o)), o -> {agreed} AND {has_key}), o -> {covered}), c -> c >= {LEAST_SHARE}D))"
        return f"CASE WHEN size({v}) >= {LEAST_VOTES} THEN {best} END"

    found = staged.select("*", *(F.expr(starts(t)).alias(f"at_{t.label}") for t in templates), *(F.expr(votes(t)).alias(f"votes_{t.label}") for t in licences))
    found = found.select("*", *(F.expr(whole(t)).alias(f"whole_{t.label}") for t in licences))
    base = F.flatten(F.array(*(F.col(f"`at_{t.label}`") for t in templates if t.base)))
    sentences = lambda some: [F.when(F.size(f"`at_{t.label}`") > 0, F.lit(t.label)) for t in some]
    names = lambda some: F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*some)))), ",")
    scores = [*(F.expr(share(t)) for t in templates), *(F.col(f"`whole_{t.label}`") for t in licences)]
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        names(sentences([t for t in templates if t.base])).alias("base_labels"),
        names([*sentences(templates), *(F.when(F.col(f"`whole_{t.label}`").isNotNull(), F.lit(t.label)) for t in licences)]).alias("labels"),
        F.coalesce(F.greatest(*scores), F.lit(0.0)).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES, licences: tuple[Template, ...] = LICENCES, id_col: str = "doc_id") -> str:
    """The same result in DuckDB, by looking at every word of every text."""
    quoted = lambda ws: "[" + ",".join(f"'{w}'" for w in ws) + "]"
    rows = lambda some: ",".join(f"('{t.label}', {quoted(t.words)}, {quoted(t.key)}, {t.at}, {str(t.base).lower()})" for t in some)
    return f"""
    WITH d AS (
      SELECT {id_col}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
    t(label, sentence, phrase, pos, base) AS (VALUES {rows(templates)}),
    p AS (SELECT r, unnest(range(len(w))) AS s, unnest(w) AS x FROM d),
    m AS (
      SELECT d.r, p.s, t.label, t.base,
             len(list_filter(range(len(t.sentence)), lambda k: p.s - t.pos + k >= 0 AND p.s - t.pos + k < len(d.w)
                 AND d.w[CAST(p.s - t.pos + k + 1 AS BIGINT)] = t.sentence[CAST(k + 1 AS BIGINT)])) / len(t.sentence) AS score
      FROM p JOIN d USING (r) JOIN t ON p.x = t.phrase[1] AND d.w[CAST(p.s + 1 AS BIGINT):CAST(p.s + len(t.phrase) AS BIGINT)] = t.phrase),
    l(label, sentence, phrase, pos, base) AS (VALUES {rows(licences)}),
    lw AS (SELECT label, unnest(range(len(sentence))) AS k, unnest(sentence) AS x FROM l),
    df AS (SELECT x, count(DISTINCT r) AS n FROM p WHERE x IN (SELECT x FROM lw) GROUP BY x),
    ranked AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY coalesce(max(n), 0), length(x) DESC, min(k)) AS i FROM lw LEFT JOIN df USING (x) GROUP BY label, x),
    v AS (SELECT p.r, lw.label, p.s - lw.k AS o, p.x FROM p JOIN lw USING (x) JOIN ranked USING (label, x) WHERE i <= {ANCHORS}),
    o AS (SELECT a.r, a.label, a.o FROM (SELECT DISTINCT r, label, o FROM v) a JOIN v b ON a.r = b.r AND a.label = b.label AND abs(a.o - b.o) <= {SHIFT} GROUP BY ALL HAVING count(DISTINCT b.x) >= {LEAST_VOTES}),
    h AS (
      SELECT o.*, l.sentence FROM o JOIN l USING (label) JOIN d USING (r)
      WHERE len(list_filter(range({2 * SHIFT + 1}), lambda j: o.o + l.pos - {SHIFT} + j >= 0 AND d.w[CAST(greatest(o.o + l.pos - {SHIFT} + j, 0) + 1 AS BIGINT):CAST(greatest(o.o + l.pos - {SHIFT} + j, 0) + len(l.phrase) AS BIGINT)] = l.phrase)) > 0),
    c AS (SELECT h.r, h.label, h.o, CAST(count(DISTINCT lw.k) AS DOUBLE) / any_value(len(h.sentence)) AS score FROM h JOIN lw USING (label) JOIN p ON p.r = h.r AND p.x = lw.x AND abs(p.s - lw.k - h.o) <= {SHIFT} GROUP BY ALL),
    every AS (
      SELECT r, s, label, base, score FROM m
      UNION ALL SELECT r, NULL, label, false, max(score) FROM c GROUP BY r, label HAVING max(score) >= {LEAST_SHARE}),
    a AS (
      SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM every GROUP BY r)
    SELECT {id_col}, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN a USING (r)"""
