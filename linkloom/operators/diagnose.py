"""Reports on errors, and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.operators.evaluate import DECIMALS
from linkloom.operators.features import with_records
from linkloom.sources.shared import kept

# The predicates of the profile of missed pairs.
MISS_PREDICATES = {
    "name_exact": "name_exact = 1", "name_ratio_95": "name_ratio >= 0.95", "name_ratio_90": "name_ratio >= 0.9", "name_ratio_80": "name_ratio >= 0.8",
    "name_jaccard_80": "name_jaccard >= 0.8", "name_jaccard_60": "name_jaccard >= 0.6", "shared_name_token": "shared_name_tokens >= 1",
    "address_number_equal": "address_number_equal = 1", "address_ratio_90": "address_ratio >= 0.9", "address_ratio_80": "address_ratio >= 0.8",
    "address_jaccard_60": "address_jaccard >= 0.6", "shared_address_token": "shared_address_tokens >= 1", "country_equal": "country_equal = 1",
    "name_ratio_90_country": "name_ratio >= 0.9 and country_equal = 1", "name_ratio_80_country": "name_ratio >= 0.8 and country_equal = 1",
    "name_jaccard_60_country": "name_jaccard >= 0.6 and country_equal = 1", "name_ratio_80_number": "name_ratio >= 0.8 and address_number_equal = 1",
    "name_ratio_80_address": "name_ratio >= 0.8 and shared_address_tokens >= 1", "name_ratio_90_number": "name_ratio >= 0.9 and address_number_equal = 1",
}


def overmatched(spine_counts: DataFrame) -> DataFrame:
    """S1 entities with a true match found and more predictions than true matches."""
    return spine_counts.where((F.col("n_true") > 0) & (F.col("n_pred") > F.col("n_true")) & (F.col("tp") > 0))


def overmatch_report(counts: DataFrame, predicted: DataFrame, truth: DataFrame, scored: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The predictions of overmatched entities, with score, features if given, and whether they are true; false ones first."""
    key = ["s1_id", "cand_id"]
    rows = predicted.select(*key).distinct().join(overmatched(counts).select("s1_id"), "s1_id", "left_semi")
    rows = rows.join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "left").join(scored.select(*key, "score"), key, "left")
    kind = F.when(F.col("t").isNotNull(), "TRUE_MATCH").otherwise("FALSE_MATCH")
    extra = []
    if features is not None:
        extra = [c for c in features.columns if c not in key]
        rows = rows.join(features, key, "left")
    return _false_first(rows.select(*key, "score", *extra, kind.alias("match_type")))


def overmatch_rows(pairs: DataFrame) -> DataFrame:
    """The same from the labelled pairs (s1_id, cand_id, score, label, features) of overmatched entities."""
    kind = F.when(F.col("label") == 1, "TRUE_MATCH").otherwise("FALSE_MATCH")
    extra = [c for c in pairs.columns if c not in ("s1_id", "cand_id", "score", "label")]
    return _false_first(pairs.select("s1_id", "cand_id", "score", *extra, kind.alias("match_type")))


def _false_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("s1_id", "match_type", F.desc("score"))


def missed_pairs(truth: DataFrame, edges: DataFrame, ref: DataFrame) -> DataFrame:
    """True pairs that no candidate covers, whose target exists."""
    key = ["s1_id", "cand_id"]
    return truth.select(*key).distinct().join(edges, key, "left_anti").join(ref.select(F.col("entity_id").alias("cand_id")).distinct(), "cand_id", "left_semi").select(*key)


def miss_features(missed: DataFrame, rows: DataFrame, similar=S.matching_blocks_ratio) -> DataFrame:
    """Similarities and texts of missed pairs. rows: entity_id, name, addr, ctry, number in ASCII form."""
    pairs = with_records(missed, rows.select("entity_id", "name", "addr", "ctry", "number"))
    tok = lambda c: N.tokens(F.col(c))
    shared = lambda c: F.size(F.array_intersect(tok(f"a.{c}"), tok(f"b.{c}")))
    return pairs.select(
        "s1_id", "cand_id", S.equal(F.col("a.name"), F.col("b.name")).alias("name_exact"), similar(F.col("a.name"), F.col("b.name")).alias("name_ratio"),
        S.jaccard(tok("a.name"), tok("b.name")).alias("name_jaccard"), S.overlap(tok("a.name"), tok("b.name")).alias("name_overlap"), shared("name").alias("shared_name_tokens"),
        S.equal(F.col("a.addr"), F.col("b.addr")).alias("address_exact"), similar(F.col("a.addr"), F.col("b.addr")).alias("address_ratio"),
        S.jaccard(tok("a.addr"), tok("b.addr")).alias("address_jaccard"), S.overlap(tok("a.addr"), tok("b.addr")).alias("address_overlap"), shared("addr").alias("shared_address_tokens"),
        S.equal(F.col("a.number"), F.col("b.number")).alias("address_number_equal"), S.equal(F.col("a.ctry"), F.col("b.ctry")).alias("country_equal"),
        F.col("a.name").alias("s1_name"), F.col("b.name").alias("true_name"), F.col("a.addr").alias("s1_address"), F.col("b.addr").alias("true_address"),
    )


def miss_sums(features: DataFrame) -> DataFrame:
    """One row: how many missed pairs there are (all), and how many satisfy each predicate."""
    return features.agg(F.count("*").alias("all"), *[F.sum(F.expr(p).cast("long")).alias(name) for name, p in MISS_PREDICATES.items()])


def miss_profile(features: DataFrame) -> DataFrame:
    """How many missed pairs satisfy each predicate: (predicate, pairs, share)."""
    return profiled(miss_sums(features))


def profiled(sums: DataFrame) -> DataFrame:
    """miss_profile from rows as miss_sums makes them, which are added up."""
    sums = sums.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("all", *MISS_PREDICATES)])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("predicate"), F.col(name).alias("pairs")) for name in MISS_PREDICATES]))
    return sums.select("all", pairs.alias("x")).select("x.predicate", "x.pairs", F.coalesce(F.try_divide("x.pairs", "all"), F.lit(0.0)).alias("share"))


#: Bins that the values of a column fall into, and the percentiles that are asked for.
BINS, POINTS = 4096, (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def describe(rows: DataFrame, columns: list[str], points: tuple = POINTS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles of each column, a row each."""
    return described(value_counts(rows, columns), points)


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have each value of each column: (column, v, n); n is 0 for nulls."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
    return rows.select(F.explode(F.array(*[one(c) for c in columns])).alias("x")).select("x.*").groupBy("column", "v").agg(F.count("v").alias("n"))


def described(counts: DataFrame, points: tuple = POINTS) -> DataFrame:
    """describe from rows (column, v, n), which may repeat a value.

    Ranks follow from the counts of bins and from sums within each bin, so that no task holds a column's values.
    """
    counts = kept(counts.groupBy("column", "v").agg(F.sum("n").alias("n")))
    weighted = counts.groupBy("column").agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"), F.min("v").alias("min"), F.max("v").alias("max"))
    off = (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")) * F.col("x.n")
    facts = counts.alias("x").join(F.broadcast(weighted.select("column", "m")), "column").groupBy("column").agg(F.sum(off).alias("off"))
    facts = kept(weighted.join(facts, "column"))  # a row for each column
    small = F.broadcast(facts.select("column", F.col("n").alias("total"), F.col("min").alias("low"), F.col("max").alias("high")))
    bin_ = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).otherwise(F.lit(0))
    binned = counts.where("v IS NOT NULL").join(small, "column").withColumn("bin", bin_)
    before = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("column", "bin").agg(F.sum("n").alias("size")).select("column", "bin", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("column", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.join(F.broadcast(bins), ["column", "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    at = lambda p: F.lit(p) * (F.col("total") - 1)
    holds = lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
    ends = [F.max(F.when(holds(f(at(p))), F.col("v"))).alias(f"{side}{k}") for k, p in enumerate(points) for side, f in (("l", F.floor), ("h", F.ceil))]
    found = placed.groupBy("column").agg(F.first("total").alias("total"), *ends)
    value = lambda k, p: F.round(F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) * (at(p) - F.floor(at(p))), DECIMALS)
    found = found.select("column", *[value(k, p).alias(f"p{round(100 * p):02d}") for k, p in enumerate(points)])
    std = F.when(F.col("n") > 1, F.round(F.sqrt(F.col("off") / (F.col("n") - 1)), DECIMALS))
    out = facts.join(found, "column", "left")
    return out.select("column", "n", F.round("m", DECIMALS).alias("mean"), std.alias("std"), "min", "max", *[c for c in found.columns if c != "column"])


def column_profile(records: DataFrame, columns: tuple = ("business_name", "business_address", "country")) -> DataFrame:
    """Rows, blanks and lengths of stripped texts: a row for each source and column."""
    stripped = lambda c: F.length(F.regexp_replace(N.text(F.col(c)), r"^\s+|\s+$", ""))
    rows = records.select("src", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), stripped(c).alias("n")) for c in columns])).alias("x")).select("src", "x.*")
    return rows.groupBy("src", "column").agg(F.count("*").alias("rows"), F.sum((F.col("n") == 0).cast("long")).alias("blanks"), F.min("n").cast("long").alias("min_len"), F.max("n").cast("long").alias("max_len"), F.avg("n").alias("mean_len"))


def value_histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def match_histogram(counts: DataFrame) -> DataFrame:
    """S1 entities by number of true matches, with their percentage."""
    by = counts.groupBy("n_true").agg(F.count("*").alias("entities"))
    total = counts.agg(F.count("*").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("n_true", "entities", (F.lit(100.0) * F.col("entities") / F.col("total")).alias("percent"))


def singleton_rate(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg((F.col("n_true") == 0).cast("double")).alias("singleton_rate"))
