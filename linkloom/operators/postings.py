"""Postings (entity, country, token), document frequencies, anchors and caps.

Postings are rows, never lists: a token's entities lie as many rows over many tasks. Small caps are windows that Spark
prunes on the map side; it does so up to PRUNED rows, so that larger caps are windows over salted keys first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import normalize as N


#: Rows of a window up to which Spark prunes before the shuffle, and salts of a key where it does not.
PRUNED, SALTS = 1000, 64


@dataclass(frozen=True)
class BlockConfig:
    """What tells the blockers apart."""

    min_len: int = 4
    max_df: int = 50_000
    posting_cap: int = 50_001
    top_k: int = 1
    repeat_tokens: bool = False
    ties_by_place: bool = False
    name_cap: int = 100
    number_cap: int = 1000
    address_cap: int = 500
    df_fraction: float = 0.001
    bucket_cap: int = 6000
    ref_k: int = 5
    s1_k: int = 5
    min_shared: int = 2


def prepared(records: DataFrame) -> DataFrame:
    """Records with name, addr, ctry in ASCII form and the first house number; raw fields stay."""
    out = records.withColumns({"name": N.ascii_text(F.col("business_name")), "addr": N.ascii_text(F.col("business_address")), "ctry": N.ascii_text(F.col("country"))})
    return out.withColumn("number", N.first_number(F.col("addr")))


def exploded(records: DataFrame, tokens: Column, country: str = "ctry", place: bool = False) -> DataFrame:
    """(entity_id, src, country, token), with the token's place if asked for."""
    base = records.select("entity_id", "src", F.col(country).alias("country"), tokens.alias("t"))
    if place:
        return base.select("entity_id", "src", "country", F.posexplode("t").alias("place", "token"))
    return base.select("entity_id", "src", "country", F.explode("t").alias("token"))


def numbered(records: DataFrame, tokens: Column) -> Column:
    """A number for each token, so that sets compare faster than as texts; texts where a number would stand for two of them."""
    of = lambda t: F.xxhash64(t)
    each = records.select(F.explode(tokens).alias("token")).distinct()
    sound = each.groupBy(of("token").alias("n")).count().where("count > 1").isEmpty()
    return F.transform(tokens, of) if sound else tokens


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def posting_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("country", "token").agg(F.count("*").alias("posting_size"))


def capped(postings: DataFrame, cap: int, key: tuple = ("country", "token"), order: tuple = ("src", "entity_id")) -> DataFrame:
    """The first rows of each posting, in a total order.

    Of a large posting, each salt's first rows are found in a task of their own; no more than SALTS * cap rows of a key
    meet in the end.
    """
    first = lambda rows, by: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    if cap > PRUNED:
        postings = first(postings.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS))), (*key, "_salt")).drop("_salt")
    return first(postings, key)


def rarest(postings: DataFrame, df: DataFrame, k: int, max_df: int | None = None) -> DataFrame:
    """Each entity's k rarest usable tokens by (df, token). Rows that repeat a token take up a place each."""
    usable = df if max_df is None else df.where(F.col("df") <= max_df)
    rows = postings.join(usable, "token")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("df", "token"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def smallest_posting(s1_tokens: DataFrame, sizes: DataFrame, by_place: bool = False, max_size: int | None = None) -> DataFrame:
    """For each S1 entity, its token whose posting is smallest: (entity_id, country, token, posting_size)."""
    usable = sizes if max_size is None else sizes.where(F.col("posting_size") <= max_size)
    ties = "place" if by_place else "token"
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("posting_size", ties))
    rows = s1_tokens.join(usable, ["country", "token"])
    return rows.withColumn("rank", place).where(F.col("rank") == 1).select("entity_id", "country", "token", "posting_size")
