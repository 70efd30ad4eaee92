"""Language of texts by profiles of character n-grams: naive Bayes over runs of one to three letters.

Counts of runs are made in the tasks from a bounded sample of labelled texts and added up by groupBy; what reaches the
driver is a table of languages and buckets. Texts are scored in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Labelled texts that the profiles are counted from, chosen by a hash of the text, and the languages they may have.
FIT_ROWS, MOST_LANGUAGES = 20_000, 200
#: Buckets of runs, a power of two, and how long runs are at most.
BUCKETS, LONGEST = 1 << 15, 3
#: What every run counts besides its own occurrences.
SMOOTH = 0.5
#: Runs of one text aren't independent: its likelihood is taken to so small a power.
TEMPER = 0.5

_OTHER = re.compile(r"[\W\d_]+")


def runs(text: str | None) -> np.ndarray:
    """The buckets of all runs of up to LONGEST letters of a whole text, of which blanks mark the ends of words; none
    without letters."""
    bare = _OTHER.sub(" ", (text or "").lower()).strip()
    if not bare:
        return np.zeros(0, dtype=np.int64)
    letter = np.frombuffer(f" {bare} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    out, hashed = [], np.zeros(len(letter), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        hashed = hashed[: len(letter) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + letter[n - 1 :] + np.uint64(n)
        mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        own = (mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1)
        out.append(own[letter != 32] if n == 1 else own)
    return np.concatenate(out).astype(np.int64)


@dataclass
class Profiles:
    """The languages, and the logarithm of each bucket's share in each of them as [bucket, language]."""

    names: list[str]
    logs: np.ndarray

    def shares(self, text: str | None) -> np.ndarray | None:
        """Each language's probability; None for a text without letters."""
        at = runs(text)
        if not len(at) or not self.names:
            return None
        where, n = np.unique(at, return_counts=True)
        log = (n @ self.logs[where]) * TEMPER
        p = np.exp(log - log.max())
        return p / p.sum()

    def best(self, text: str | None, least: float = 0.0) -> str | None:
        p = self.shares(text)
        return None if p is None or p.max() < least else self.names[int(p.argmax())]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Profiles:
    """Profiles of the languages of at most `rows` distinct labelled texts. Null labels and texts without letters don't
    count; of a text with several labels the smallest does. More than MOST_LANGUAGES languages are an error."""
    import pyarrow as pa

    own = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    picked = F.broadcast(own.groupBy("key").agg(F.min("lang").alias("lang")).orderBy("key").limit(rows))
    some = own.select("key", "text").join(picked, "key").dropDuplicates(["key"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang_, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = runs(text_)
                if len(at):
                    total.setdefault(lang_, np.zeros(BUCKETS, dtype=np.int64))
                    total[lang_] += np.bincount(at, minlength=BUCKETS)
        for lang_, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = some.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most BUCKETS rows a language
    names = sorted(set(got.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages, more than {MOST_LANGUAGES}")
    table = np.full((BUCKETS, len(names)), SMOOTH)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(table, (got.column("bucket").to_numpy(), np.array([place[x] for x in got.column("lang").to_pylist()], dtype=np.int64)), got.column("n").to_numpy())
    return Profiles(names, np.log(table / table.sum(axis=0)) if names else table)


def detector(profiles: Profiles, least: float = 0.0) -> Callable[[Column], Column]:
    """A function of a text column that gives its language: null for texts without letters, and where no language has a
    probability of at least `least`. It suits standardize.flatten_documents()."""
    @pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        return pd.Series([profiles.best(t, least) for t in texts], dtype=object)

    return language


def english_only(df: DataFrame, profiles: Profiles, text: str = "question", wanted: str = "en", least: float = 0.0) -> DataFrame:
    """Rows whose text is in the wanted language; null, empty and letterless texts go."""
    return df.where(F.coalesce(detector(profiles, least)(F.col(text)) == wanted, F.lit(False)))
