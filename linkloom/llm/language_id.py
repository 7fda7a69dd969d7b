"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three letters, words padded by a
separator). A document's own list is compared with each profile: every n-gram costs the distance between its two ranks,
or the most possible where the profile lacks it; the language of least cost wins.

Profiles are fitted on a bounded sample of labelled rows, TRAIN_ROWS or so for each language, taken by a digest of the
identifier. Prediction reads the text alone.

Cases: null text, or one without a letter, is `und` with score 0, as is every text when no language could be learned;
whole texts count; ties between languages go to the smaller code, ties between n-grams to the smaller letters; rows
without a language teach nothing; repeated rows get the same answer; extra columns are ignored or kept as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import held_out, ship

#: n-grams in a profile, and rows of a language that its profile is fitted on (about).
DEPTH = 400
TRAIN_ROWS = 4000
#: Languages that are learned, by number of rows; more than ISO 639-3 has codes.
MAX_LANGUAGES = 8192
_SEPARATOR = 1


@cache
def _letters():
    import numpy as np

    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(text: str):
    """The text's n-grams as numbers, 21 bits a letter; None if it has no letter."""
    import numpy as np

    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate(([_SEPARATOR], np.where(letter, codes, _SEPARATOR), [_SEPARATOR]))
    again = (codes[1:] == _SEPARATOR) & (codes[:-1] == _SEPARATOR)
    codes = np.concatenate((codes[:1], codes[1:][~again]))
    pairs = codes[:-1] << 21 | codes[1:]
    threes = (pairs[:-1] << 21 | codes[2:])[codes[1:-1] != _SEPARATOR]
    return np.concatenate((codes[codes != _SEPARATOR], pairs, threes))


def most_frequent(found, depth: int):
    """The most frequent n-grams, in order of rank."""
    import numpy as np

    values, counts = np.unique(found, return_counts=True)
    if len(values) > depth:
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.argsort(-counts, kind="stable")][:depth]


class Profiles:
    """Profiles of all languages as one table: sorted n-grams, and their ranks in each language."""

    def __init__(self, profiles: dict[str, list[int]], depth: int):
        import numpy as np

        self.langs, self.depth = sorted(profiles), depth
        self.grams = np.array(sorted(set().union(*profiles.values())) if profiles else [], np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        found = grams(text) if text and self.langs else None
        if found is None:
            return "und", 0.0
        own = most_frequent(found, self.depth)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        cost = np.where(ranks < 0, self.depth, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(cost.argmin())
        return self.langs[best], float(1.0 - cost[best] / (len(own) * self.depth))


def _count(batches):
    """(lang, gram, n) for the rows of each batch."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = grams(text) if text else None
            if found is not None:
                by_lang.setdefault(lang, []).append(np.unique(found, return_counts=True))
        for lang, parts in by_lang.items():
            values, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": counts})


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, depth: int = DEPTH, rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles from the labelled rows of df that `train` holds for."""
    from pyspark.sql import Window

    ship(df.sparkSession)
    lang = F.col(f"`{lang_col}`").cast("string")
    use = lang.isNotNull() & (F.lit(True) if train is None else F.coalesce(train, F.lit(False)))
    totals = df.where(use).groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not totals:
        return Profiles({}, depth)
    share = F.element_at(F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, rows / r["n"]))]), lang)
    drawn = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("profile")), F.lit(1 << 20)) < F.coalesce(share, F.lit(0.0)) * float(1 << 20)
    counts = df.where(use & drawn).select(lang, F.col(f"`{text_col}`")).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= depth).collect()  # depth rows for each language
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, depth)


def predictor(profiles: Profiles):
    """A column function: text -> struct(lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def op6(df: DataFrame) -> DataFrame:
    out = held_out(F.col("doc_id"))
    predict = predictor(fit(df, train=~out))
    return df.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
