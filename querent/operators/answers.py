"""Answers within texts: an automaton over all answers reads each text once, whatever the answers' length.

Answers are a stated set of things looked for, cut into blocks; each task builds the automaton of its block and runs it
over its share of the distinct texts. Texts of a block are dealt by their hash to shares of bounded size, so equal
texts are read once and no share grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.text import containment_form

#: Characters of the answers of a block, and of the texts of a share.
BLOCK_CHARS, SHARE_CHARS = 8 << 20, 32 << 20


def key_of(text: Column) -> Column:
    """What stands for a text in the result of answers_in_texts()."""
    return F.md5(containment_form(text))


def answers_in_texts(texts: DataFrame, answers: DataFrame, text: str = "text", answer: str = "answer") -> DataFrame:
    """(text_key, answer_key, places): each distinct text with each distinct answer that it holds, both as the key_of()
    their form without white space and underscores, and the places (array<long>, from 0, rising) in the text's form
    where the answer begins, which may overlap.

    Null texts and answers, and answers that are empty in that form, are not looked for.
    """
    import pyarrow as pa

    forms = lambda df, c: df.select(containment_form(F.col(c)).alias("f")).where("f is not null and f <> ''").distinct()
    t, a = forms(texts, text), forms(answers, answer)
    size = lambda df: df.agg(F.sum(F.length("f"))).first()[0] or 0
    blocks, shares = -(-size(a) // BLOCK_CHARS) or 1, -(-size(t) // SHARE_CHARS) or 1
    dealt = lambda n: F.pmod(F.xxhash64("f"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = t.select("f", F.md5("f").alias("key"), every(blocks).alias("block"), dealt(shares).alias("share"))
    right = a.select("f", F.md5("f").alias("key"), dealt(blocks).alias("block"), every(shares).alias("share"))

    def find(some: pa.Table, wanted: pa.Table) -> pa.Table:
        import ahocorasick

        machine = ahocorasick.Automaton()
        keys, sizes = wanted.column("key").to_pylist(), []
        for i, f in enumerate(wanted.column("f").to_pylist()):
            machine.add_word(f, i)
            sizes.append(len(f))
        out: tuple[list, list, list] = ([], [], [])
        if keys:
            machine.make_automaton()
            for key, f in zip(some.column("key"), some.column("f")):
                met: dict[int, list[int]] = {}
                for end, i in machine.iter(f.as_py()):
                    met.setdefault(i, []).append(end - sizes[i] + 1)
                out[0].extend([key.as_py()] * len(met))
                out[1].extend(keys[i] for i in met)
                out[2].extend(met.values())
        return pa.table({"text_key": pa.array(out[0], pa.string()), "answer_key": pa.array(out[1], pa.string()), "places": pa.array(out[2], pa.list_(pa.int64()))})

    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(find, "text_key string, answer_key string, places array<long>")
