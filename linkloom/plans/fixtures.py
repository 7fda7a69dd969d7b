"""Business records made from the driver's documents, and their true matches.

Every document is one record: its source follows from doc_id, its name, address and true key from its text, its country
from its language. Documents that are copies of each other so become records that match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.normalize import ascii_text, text

#: Least length of a true key.
KEY_LENGTH = 60


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, src (1: the deduplicated source; 2, 3: the noisy ones), business_name, business_address, country, truth_key."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = text(F.col("text"))
    src = F.pmod(F.col("doc_id"), F.lit(3)) + 1
    return d.select(
        F.concat(F.lit("S"), src, F.lit("-"), F.col("doc_id")).alias("entity_id"),
        src.alias("src"),
        F.substring(body, 1, 32).alias("business_name"),
        F.concat(F.pmod(F.coalesce("n_chars", F.lit(0)), F.lit(97)).cast("string"), F.lit(" "), F.substring(body, 33, 64)).alias("business_address"),
        text(F.col("lang")).alias("country"),
        ascii_text(F.substring(body, 97, 100)).alias("truth_key"),
    )


def spine(rows: DataFrame) -> DataFrame:
    return rows.where("src = 1").select(F.col("entity_id").alias("s1_id"))


def truth(rows: DataFrame) -> DataFrame:
    keyed = rows.where(F.length("truth_key") >= KEY_LENGTH)
    s1 = keyed.where("src = 1").select(F.col("entity_id").alias("s1_id"), "truth_key")
    ref = keyed.where("src <> 1").select(F.col("entity_id").alias("cand_id"), "truth_key")
    return s1.join(ref, "truth_key").select("s1_id", "cand_id")


#: Rows of texts that are awkward to write: quotes, separators, line breaks, spaces at the ends, an escape character.
AWKWARD = (
    ("S1-900001", 'a "b" c', "12 \t Main", "US"), ("S2-900002", '"', "line\nbreak", ""), ("S3-900003", "  12 x ", "back\\slash", " FR"),
    ("S2-900004", '""', 'quote at end"', "x,y"), ("S1-900005", "NA", "null", ""),
)

#: Rows written out by hand: a name, an address and a country, and what the canonical forms must be: name, core, suffix, address, country.
BY_HAND = (
    ("A&B Foods, Inc.", "12, Main St. #4", "USA", "a and b foods inc", "a and b foods", "inc", "12 main street #4", "US"),
    ("\uff21\uff23\uff2d\uff25 Ltd", "\uff11\uff12 Main Rd", "cote d'ivoire", "acme ltd", "acme", "ltd", "12 main road", "Cote D'Ivoire"),
    ("\ufb01ne \u2460 Corp", "\u216b Elm Ave", "new\u3000zealand", "fine 1 corp", "fine 1", "corp", "xii elm avenue", "New Zealand"),
    ("Cafe\u0301 SARL", "5\u00bd N Bd", "u.s.a.", "caf\u00e9 sarl", "caf\u00e9", "sarl", "51 2 north bd", "US"),
    ("Acme L.L.C.", "N St. Mary", "xx", "acme l l c", "acme l l c", "", "north street mary", "XX"),
    ("Company", "", " Great  Britain ", "company", "", "company", "", "GB"),
    ("Acme Pvt. Ltd.", "Avenue drst", "bosnia-herzegovina", "acme pvt ltd", "acme", "pvt ltd", "avenue drst", "Bosnia-Herzegovina"),
    (None, None, None, "", "", "", "", ""),
)


def by_hand(spark: SparkSession) -> DataFrame:
    rows = [(f"S1-{k}", *r[:3]) for k, r in enumerate(BY_HAND)]
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


def doc_id(c: str):
    return F.regexp_extract(c, "-(\\d+)$", 1).cast("long")


def broken_lists(wide: DataFrame) -> DataFrame:
    """Lists with every kind of violation, by identifier: rows gone, rows twice, entities, members and repeats that should not be."""
    n, own, ids = doc_id("source1_entity_id"), F.col("source1_entity_id"), F.col("matched_entity_ids")
    more = F.when(n % 13 == 0, F.concat(ids, F.lit(",S2-none"))).when(n % 17 == 0, F.concat(ids, F.lit(",S2-1, S2-1"))).otherwise(ids)
    rows = wide.select(own, more.alias("matched_entity_ids"), n.alias("n"))
    rows = rows.where("n % 7 <> 0").unionAll(rows.where("n % 11 = 0")).unionAll(rows.where("n % 19 = 0").select(F.concat(own, F.lit("-x")), "matched_entity_ids", "n"))
    return rows.drop("n")
