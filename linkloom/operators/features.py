"""The thirteen features of a pair, and its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.schema import FEATURES


def canonical_records(records: DataFrame) -> DataFrame:
    """entity_id with canonical name, core, suffix, address, country and house number."""
    out = records.select("entity_id", N.canonical_name(F.col("business_name")).alias("name"), N.canonical_address(F.col("business_address")).alias("address"), N.canonical_country(F.col("country")).alias("country"))
    out = out.withColumn("suffix", N.legal_suffix(F.col("name")))
    return out.withColumns({"core": N.name_core(F.col("name"), F.col("suffix")), "number": N.first_number_unicode(F.col("address"))})


def with_records(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Both records of each pair, as structs a and b; a pair with an unknown record goes."""
    a = records.select(F.col("entity_id").alias("s1_id"), F.struct(*[c for c in records.columns if c != "entity_id"]).alias("a"))
    b = records.select(F.col("entity_id").alias("cand_id"), F.struct(*[c for c in records.columns if c != "entity_id"]).alias("b"))
    return edges.join(a, "s1_id").join(b, "cand_id").select("s1_id", "cand_id", "a", "b")


def missing_records(edges: DataFrame, records: DataFrame) -> DataFrame:
    """One row: pairs of which a record is unknown."""
    known = records.select("entity_id").distinct()
    have = edges.join(known, edges["s1_id"] == known["entity_id"], "left_semi").join(known, edges["cand_id"] == known["entity_id"], "left_semi")
    return edges.agg(F.count("*").alias("all")).crossJoin(have.agg(F.count("*").alias("have"))).select((F.col("all") - F.col("have")).alias("missing_pairs"))


def pair_features(edges: DataFrame, records: DataFrame) -> DataFrame:
    """records: as canonical_records makes them."""
    return compared(with_records(edges, records))


def compared(rows: DataFrame, *more: Column) -> DataFrame:
    """The features of pairs that come with both of their records, and what more is asked of these."""
    tok = lambda c: N.tokens(F.col(c))
    rows = rows.select("s1_id", "cand_id", "a", "b", *more, S.ratio(F.col("a.name"), F.col("b.name")).alias("name_ratio"), S.ratio(F.col("a.address"), F.col("b.address")).alias("address_ratio"))
    found = {
        "name_exact": S.equal(F.col("a.name"), F.col("b.name")), "name_core_exact": S.equal(F.col("a.core"), F.col("b.core")),
        "name_jaccard": S.jaccard(tok("a.name"), tok("b.name")), "name_overlap": S.overlap(tok("a.name"), tok("b.name")),
        "address_exact": S.equal(F.col("a.address"), F.col("b.address")), "address_jaccard": S.jaccard(tok("a.address"), tok("b.address")), "address_overlap": S.overlap(tok("a.address"), tok("b.address")),
        "address_number_equal": S.equal(F.col("a.number"), F.col("b.number")), "country_equal": S.equal(F.col("a.country"), F.col("b.country")),
        "name_address_mean": (F.col("name_ratio") + F.col("address_ratio")) / 2, "name_address_min": F.least("name_ratio", "address_ratio"),
    }
    return rows.withColumns(found).select("s1_id", "cand_id", *FEATURES, *rows.columns[4:-2])


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label 1 if the truth has the pair."""
    marks = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(marks, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
