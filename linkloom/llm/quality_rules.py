"""Quality rules with adaptive thresholds.

Each document gets counts (words, symbols, repeated lines, words in repeated three-word windows) by built-in functions
alone. Instead of fixed cutoffs, every language and source has its own: mergeable quantile sketches, built on the map
side and merged, give quartiles of each ratio over its documents, and a document fails where a ratio lies further beyond
the upper quartile than REACH times the spread. Documents meet their thresholds in a join.

Cases: null and blank texts have no words and fail the base rules; a null language or source is a group of its own; ties
and repeated rows are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, words

#: Quantile sketches: relative error of a rank is 1 / ACCURACY.
ACCURACY = 1000
#: Interquartile ranges beyond the upper quartile that a ratio may lie, and the least spread that counts as one.
REACH = 6.0
LEAST_SPREAD = {"symbol_ratio": 0.01, "dup_line_ratio": 0.1, "repeat_ratio": 0.06, "word_length": 0.02}
MIN_WORDS = 50
RATIOS = tuple(LEAST_SPREAD)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Bits for a word's place in the keys that find repeated windows; the rest hold a hash.
_PLACE = 30


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _neighbours_equal(items: Column, key) -> Column:
    """The items of a sorted array whose key equals a neighbour's."""
    same = lambda x, i: (key(F.get(items, i - 1)) == key(x)) | (key(F.get(items, i + 1)) == key(x))
    return F.filter(items, lambda x, i: F.coalesce(same(x, i), F.lit(False)))


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Windows whose hashes meet in a sort of longs are few; of those, the words themselves are compared.
    """
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashed = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _PLACE + 1), _PLACE)
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: hashed(i).bitwiseOR(i.cast("long")))
    near = _let(F.sort_array(keys), lambda k: _neighbours_equal(k, lambda x: F.shiftright(x, _PLACE)))
    exact = F.transform(near, lambda k: F.struct(window(k.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")).alias("g"), k.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int").alias("i")))
    twice = _let(F.sort_array(exact), lambda s: _neighbours_equal(s, lambda x: x["g"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(covered)


def base_counts(df: DataFrame, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = df.select(
        *keep,
        _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return found.select(*[c for c in found.columns if c not in ("w", "l")], "w.n_words", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))


def adaptive_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = REACH) -> DataFrame:
    """Every document's counts with base_failed and kept."""
    rows = base_counts(df, text_col, (F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source")))
    rows = rows.select(
        "*", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"), _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"), _ratio("word_chars", "n_words").alias("word_length"),
    )
    rows = checkpointed(rows)
    quartiles = [F.percentile_approx(c, [0.25, 0.75], ACCURACY).alias(c) for c in RATIOS]
    sketched = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(*quartiles)
    spread = lambda c: F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(LEAST_SPREAD[c]) * (F.lit(1.0) + F.col(c)[1]))
    limits = sketched.select(F.col("lang").alias("l"), F.col("source").alias("s"), *[(F.col(c)[1] + reach * spread(c)).alias(f"max_{c}") for c in RATIOS])
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["l"]) & rows["source"].eqNullSafe(limits["s"]), "left").drop("l", "s")
    beyond = F.lit(False)
    for c in RATIOS:
        beyond = beyond | (F.col(c) > F.col(f"max_{c}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))).withColumnRenamed("id", id_col)


def op9(df: DataFrame) -> DataFrame:
    return adaptive_filter(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) AS gram
      FROM w WHERE len(ws) >= 3),
t AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p+1, p+2]) AS q FROM t) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_ratio,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length FROM c),
q AS (SELECT lang, source, {", ".join(f"quantile_disc({c}, 0.25) AS {c}_1, quantile_disc({c}, 0.75) AS {c}_3" for c in RATIOS)}
      FROM f WHERE NOT base_failed GROUP BY lang, source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({" OR ".join(f"{c} > {c}_3 + CAST({REACH} AS DOUBLE) * greatest({c}_3 - {c}_1, CAST({LEAST_SPREAD[c]} AS DOUBLE) * (CAST(1.0 AS DOUBLE) + {c}_3))" for c in RATIOS)}, false) AS kept
FROM f LEFT JOIN q ON f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source
"""
