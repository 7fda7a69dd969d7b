"""Exact duplicates by sorting content: sampled splitters range-partition the normalised bytes, an external sort puts
equal texts next to each other, and each row is compared in full with its neighbour.

Range partitioning works on a bounded key (the first bytes and a digest), so the sampled splitters stay small whatever
the length of the texts. A digest with very many rows is hot: its rows are salted over several partitions, each of which
is sorted on its own, and the few representatives that are left are compared in full once more. The count that finds hot
digests is combined on the map side and only decides where rows go, never what equals what.

Cases: null text equals the empty one; rows repeated with the same identifier are one group of which one row stays; a
null identifier ranks below all others; an empty table gives an empty result; extra columns are carried in a struct, so
that their names cannot clash. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed

#: Bytes of the text in the range key.
PREFIX = 16
#: A digest is hot if it has more rows than a partition should get, and more than this.
HOT_LEAST = 500


def content_groups(df: DataFrame, text_col: str, id_col: str, keep: str = "max", normalise=None, carry: bool = False) -> DataFrame:
    """Each row's id, keep_id, group_size, kept and text_sha256.

    carry: bring the rest of each kept row along, as `row` (a struct of the other columns, and of the text if it was
    normalised), `content` and `was_null`.
    """
    spark = df.sparkSession
    text = F.col(f"`{text_col}`")
    content = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    others = [F.col(f"`{c}`") for c in df.columns if normalise or c != text_col]
    more = [F.struct(*others).alias("row"), text.isNull().alias("was_null")] if carry else []
    names = ["row", "was_null"] if carry else []

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpointed(df.select(F.sha2(content, 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")))
    share = max(HOT_LEAST, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) / (4.0 * parts)))
    # Fewer than 4 * parts digests can have more than `share` rows, so this table is small enough to broadcast.
    hot = counts.where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("ways"))
    salted = not hot.isEmpty()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), content.alias("content"), *more).withColumn("digest", F.sha2("content", 256))
    salt = F.when(F.col("ways").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id", F.lit(7)), F.col("ways")))
    prefix = F.substring(F.encode("content", "UTF-8"), 1, PREFIX)
    rows = rows.join(F.broadcast(hot), "digest", "left") if salted else rows.withColumn("ways", F.lit(None).cast("int"))
    rows = rows.select("id", "content", "digest", *names, salt.cast("int").alias("salt"), prefix.alias("prefix"))

    better = F.desc_nulls_last("id") if keep == "max" else F.asc_nulls_last("id")
    key = ["prefix", "digest", "salt"] if salted else ["prefix", "digest"]
    place = Window.partitionBy(*key).orderBy("content", better)
    dealt = rows.repartitionByRange(*key)
    # Runs of equal texts: a row begins one unless it equals its neighbour, byte for byte.
    dealt = dealt.withColumn("begins", F.coalesce(F.lag("content").over(place) != F.col("content"), F.lit(True)))
    dealt = dealt.withColumn("run", F.sum(F.col("begins").cast("int")).over(place)).withColumn("head", F.last(F.when(F.col("begins"), F.struct("id")), ignorenulls=True).over(place))
    needed = F.col("begins") if carry else F.col("begins") & (F.col("salt") > 0)
    light = dealt.select("id", "digest", "salt", "prefix", "begins", "run", F.col("head.id").alias("head"), F.when(needed, F.col("content")).alias("content"), *[F.when(F.col("begins"), F.col(n)).alias(n) for n in names])
    local = light.withColumn("size", F.count("*").over(Window.partitionBy(*key, "run")))

    # What is left of hot groups: a row for each salt and run; the full comparison is made once more.
    whole = Window.partitionBy("digest", "content").orderBy(F.desc_nulls_last("head") if keep == "max" else F.asc_nulls_last("head"), "salt")
    left = local.where(F.col("begins") & (F.col("salt") > 0)).select("digest", "salt", "run", "content", "head", "size")
    left = left.select(
        "digest", "salt", "run",
        F.first(F.struct("head")).over(whole).alias("best"),
        F.sum("size").over(Window.partitionBy("digest", "content")).alias("all_size"),
        (F.row_number().over(whole) == 1).alias("wins"),
    )
    out = local.join(F.broadcast(left), ["digest", "salt", "run"], "left") if salted else local
    merged = F.col("best").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        (F.when(merged, F.col("best.head")).otherwise(F.col("head")) if salted else F.col("head")).alias("keep_id"),
        (F.coalesce("all_size", "size") if salted else F.col("size")).alias("group_size"),
        ((F.col("begins") & F.coalesce("wins", F.lit(True))) if salted else F.col("begins")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *(["content", *names] if carry else []),
    )


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "max", normalise=None) -> DataFrame:
    """The rows that stay, with the columns of df."""
    out = content_groups(df, text_col, id_col, keep, normalise, carry=True).where("kept")
    text = F.when(~F.col("was_null"), F.col("content"))
    return out.select(*[(text if c == text_col and not normalise else F.col("row").getField(c)).alias(c) for c in df.columns])


def op5(df: DataFrame) -> DataFrame:
    return content_groups(df, "text", "doc_id")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS content FROM documents),
r AS (SELECT doc_id, content,
             first_value(doc_id) OVER (PARTITION BY content ORDER BY doc_id DESC NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY content) AS group_size,
             row_number() OVER (PARTITION BY content ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
      FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM r
"""
