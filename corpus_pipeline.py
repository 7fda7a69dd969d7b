"""A corpus from raw documents: language, exact and near duplicates, a mix of sources, tokens.

Each stage takes what the one before it kept. All but the last return the columns of documents.

Cases, for every stage: null and empty texts are equal and have no words, letters or tokens; null identifiers are identifiers
like any other, and rows that share one are told apart by a digest of their columns; rows that agree in all columns are rows
of their own until a stage that removes duplicates; extra columns are carried whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from linkloom.llm.common import checkpointed, documents, n_words, remove, scratch, some_of


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; if languages could be learned, those in which one is found."""
    profiles = language_id.fit(docs, train=~language_id.held_out(F.col("doc_id")))
    if not profiles.langs:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    return docs.where(language_id.predictor(profiles)(F.col("text"))["lang_pred"] != "und")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def _key(docs: DataFrame):
    """What tells a row from others; rows of equal keys agree in all columns. Null identifiers come last."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("digest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that with the least
    doc_id, of several of those that with the least digest."""
    packed = docs.select(_key(docs).alias("key"), F.struct("*").alias("row"))
    keys = checkpointed(packed.select("key"))
    unique = keys.groupBy("key.id").count().where("count > 1").isEmpty()
    if unique:
        groups = simhash.similar_groups(docs)
        gone = checkpointed(groups.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id"))
        return some_of(packed.select("row", F.col("key.id").alias("id")), gone, "id", anti=True).select("row.*")
    # Where identifiers repeat, a number made from the key stands for a document.
    groups = simhash.similar_groups(packed.select(F.xxhash64("key").alias("id"), F.col("row.text").alias("text")), "id", "text")
    names = keys.distinct().select("key", F.xxhash64("key").alias("id"))
    stays = checkpointed(groups.distinct().join(names, "id").groupBy("component_id").agg(F.min("key").alias("key")).select("key"))
    return some_of(packed, stays, "key").dropDuplicates(["key"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = docs.select(F.struct("*").alias("row"), _key(docs).alias("key"))
    found = mixing.entries(rows.select("key", F.col("row.source").alias("source"), F.col("row.text").alias("text")), n_words(F.col("text")), ("key",))
    taken = checkpointed(found.where("copies > 0").select(F.col("id.key").alias("key"), "n", "copies"))
    many = checkpointed(taken.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    if not many.isEmpty():  # of rows that agree in all columns, one stands for all
        rows = some_of(rows, many, "key", anti=True).unionByName(some_of(rows, many, "key").dropDuplicates(["key"]))
    return rows.join(taken, "key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, as digests, and the digest of what they decode to."""
    return byte_bpe.encode(docs, with_ids=False, block=1_000_000, known=100_000, keep=False)  # beside what other stages hold


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("byte_bpe", tokens)]

#: Language profiles, fingerprints and dependent rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next, which removes it when it is done."""
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
