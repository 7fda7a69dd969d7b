"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target, a share of all words by its weight, stopped at three times what it has; the excess goes to
the others by weight. A document of a source whose target is f times its size is to be taken f times: floor(f) times for
certain and once more with probability frac(f). The fractional copies are rounded dependently: two documents of a source
transfer mass, weighted by their sizes and at random, until one of them is integral; the other meets the next document.
This runs within buckets of a source, in parallel; what each bucket has left meets the rest in a tree of buckets until
one document of the source is left, which is rounded to the nearer number. So a source's words differ from its target by
half a document at most, and every document's expected words are its share.

Rows that agree in identifier, source and size are interchangeable and are counted before they move, so that an identifier
which a third of all rows share is some entries with a number and not one bucket.

Cases: null text has size 0 and is taken 0 times its size; a null identifier is one like any other; a null source is a source, last in the order; equal documents
round alike only by chance but always the same way again, as randomness is a digest of the seed and the documents'
keys; repeated rows are rows of their own, whose copies differ by one at most; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, n_words, ship

WEIGHTS = (5, 2, 1)
MOST = 3.0
#: Equal documents that are rounded as one, entries that a bucket should have, and buckets that meet in a node of the tree.
CHUNK = 1_000
BUCKET = 2_000
FAN_IN = 64
#: Sources whose targets are broadcast.
FEW_SOURCES = 50_000


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size -> with weight and target. One row for each source, so its windows see sources, not documents.

    With a price p for a unit of weight, a source gets min(most * size, p * weight). Sources stop in the order of
    most * size / weight; p is the least price at which those that have not stopped take up what the stopped ones leave.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("stop", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("stop") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.partitionBy(F.lit(1))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(every))
    price = (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    # The first source, in this order, whose stop lies above the price sets it.
    ranked = ranked.withColumn("price", F.when(F.col("stop") / F.col("weight") >= price, price))
    ranked = ranked.withColumn("price", F.first("price", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("source", "source_size", F.least("stop", F.col("price") * F.col("weight")).alias("target"))


def _random(seed: int, *place) -> Iterator[float]:
    """Uniform numbers that follow from the place alone."""
    key = repr((seed, place)).encode()
    n = 0
    while True:
        digest = hashlib.blake2b(key + struct.pack("<q", n), digest_size=64).digest()
        for x in struct.unpack("<8Q", digest):
            yield (x >> 11) / (1 << 53)
        n += 1


def pivot(sizes: list[float], shares: list[float], draws: Iterator[float]) -> tuple[list[float], int]:
    """The shares after pairing all: integral but for the one whose index comes back (-1: none). Keeps sum(size * share)."""
    out = list(shares)
    left = -1
    for k in range(len(out)):
        if not 0.0 < out[k] < 1.0:
            continue
        if left < 0:
            left = k
            continue
        a, b, x, y = sizes[left], sizes[k], out[left], out[k]
        up = min((1.0 - x) * a, y * b)  # words that may go from k to left
        down = min(x * a, (1.0 - y) * b)  # and from left to k
        if next(draws) * (up + down) < down:
            x, y = (1.0, y - up / b) if (1.0 - x) * a <= y * b else (x + up / a, 0.0)
        else:
            x, y = (0.0, y + down / b) if x * a <= (1.0 - y) * b else (x - down / a, 1.0)
        x, y = (round(v) * 1.0 if abs(v - round(v)) < 1e-12 else v for v in (x, y))
        out[left], out[k] = x, y
        left = k if 0.0 < y < 1.0 else left if 0.0 < x < 1.0 else -1
    return out, left


def _round_bucket(seed: int, level: int):
    def run(key, table):
        import pyarrow as pa

        source, bucket = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("place", "ascending"), ("size", "ascending"), ("n", "ascending")])
        shares, left = pivot(table["size"].to_pylist(), table["share"].to_pylist(), _random(seed, level, source, bucket))
        return table.set_column(table.schema.get_field_index("share"), "share", pa.array(shares, pa.float64()))

    return run


def entries(df: DataFrame, size: Column, key: tuple = ("doc_id",), source_col: str = "source", weights: tuple = WEIGHTS, most: float = MOST, seed: int = 20) -> DataFrame:
    """(id, source, size, source_size, target, n, copies): how often the mix takes documents, n of them together.

    id: a struct of the key columns. Documents of equal key, source and size are counted first, on the map side, and are
    entries of up to CHUNK documents, each rounded as one.
    """
    spark = df.sparkSession
    ship(spark)
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in key]).alias("id"), F.col(f"`{source_col}`").alias("source"), size.cast("long").alias("size"))
    sized = checkpointed(named.groupBy("id", "source", "size").agg(F.count("*").alias("many")))
    by_source = checkpointed(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size")), weights, most))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / CHUNK))
    work = sized.select("*", F.explode(chunks).alias("chunk")).select("*", F.least(F.lit(CHUNK), F.col("many") - F.col("chunk") * CHUNK).alias("n"))
    counts = sized.groupBy("source").agg(F.ceil(F.sum(F.ceil(F.col("many") / CHUNK)) / F.lit(BUCKET)).cast("int").alias("buckets"))
    facts = checkpointed(by_source.join(counts, by_source.source.eqNullSafe(counts.source)).select(by_source.source.alias("s"), "source_size", "target", "buckets"))
    buckets = facts.agg(F.max("buckets")).first()[0] or 1
    # A row for each source: broadcast, which keeps a large source in many tasks, if their number is known to be small.
    if by_source.count() <= FEW_SOURCES:
        facts = F.broadcast(facts)
    rows = work.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n")).otherwise(F.lit(0.0))
    rows = rows.withColumn("place", F.xxhash64("id", "size", "chunk", F.lit(seed)))
    # What lies within 1e-9 of a whole number is that number.
    rows = rows.withColumn("factor", F.when(F.abs(factor - F.round(factor)) < 1e-9, F.round(factor)).otherwise(factor))
    rows = rows.select("*", F.floor("factor").alias("whole"), F.pmod("place", "buckets").cast("int").alias("bucket"))
    rows = rows.select("*", F.when(F.col("size") > 0, F.col("factor") - F.col("whole")).otherwise(F.lit(0.0)).alias("share"))

    work = rows.select("id", "source", "size", "source_size", "target", "n", "whole", "place", "bucket", "share")
    schema = work.schema
    settled, level, open_ = [], 0, F.col("share").between(1e-12, 1 - 1e-12)
    work = checkpointed(work.groupBy("source", "bucket").applyInArrow(_round_bucket(seed, level), schema))
    settled.append(work.where(~open_))
    work = work.where(open_)
    while buckets > 1:
        level, buckets = level + 1, -(-buckets // FAN_IN)
        work = work.withColumn("bucket", (F.col("bucket") / FAN_IN).cast("int"))
        work = checkpointed(work.groupBy("source", "bucket").applyInArrow(_round_bucket(seed, level), schema))
        settled.append(work.where(~open_))
        work = work.where(open_)
    # One entry of each source at most; the nearer way, so that its source is off by half of a document's size at most.
    settled.append(work.withColumn("share", F.round("share")))
    done = settled[0]
    for x in settled[1:]:
        done = done.unionAll(x)
    return done.select("id", "source", "size", "source_size", "target", "n", (F.col("whole") + F.round("share")).cast("long").alias("copies"))


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple = WEIGHTS, most: float = MOST, seed: int = 20) -> DataFrame:
    """id, source, size, source_size, target, copies: how often the mix takes each document."""
    found = entries(df, size, (id_col,), source_col, weights, most, seed)
    rows = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("long")
    return rows.select(F.col("id").getField(id_col).alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.cast("long").alias("copies"))


def op1(df: DataFrame) -> DataFrame:
    return mix(df, n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
