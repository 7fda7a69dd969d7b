"""Token counts with a cache of digests.

A text's count is kept under the digest of its (normalised) content and the digest of the tokenizer's file and version.
Texts whose digests the cache has are never encoded; of the others, each distinct text is encoded once and its count
appended to the cache, from which all rows then read theirs.

Equal texts collapse first within each task, so that a text that a third of the rows share moves once for each task, and
then in a sort by digest that streams. A version's part of the cache is read once for each call; what a call adds is a
folder of its own, from which it reads its new counts. Rows of a digest that very many rows share meet its count in a
broadcast.

Cases: null counts as empty and has no tokens; whole texts are encoded, without limit; repeated rows get the same count;
extra columns are ignored; an empty table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, hot_share, join_hot, scratch, ship

LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(model: bytes) -> str:
    import sentencepiece

    return hashlib.sha256(model + sentencepiece.__version__.encode()).hexdigest()


def _distinct_in_task(batches):
    """(digest, text) without what this task has already passed on."""
    import pyarrow as pa

    seen: set[bytes] = set()
    for batch in batches:
        new = [k for k, d in enumerate(batch.column(0).to_pylist()) if not (d in seen or seen.add(d))]
        yield batch.take(pa.array(new, pa.int64()))


def _count_runs(model: bytes):
    """Counts for the first row of each run of equal digests; the input is sorted by digest."""

    def run(batches):
        import pyarrow as pa
        import sentencepiece

        tokenizer, last = sentencepiece.SentencePieceProcessor(model_proto=model), None
        for batch in batches:
            digests = batch.column(0).to_pylist()
            firsts = [k for k, d in enumerate(digests) if d != (digests[k - 1] if k else last)]
            last = digests[-1] if digests else last
            counts = [len(tokenizer.encode(batch.column(1)[k].as_py(), num_threads=1)) for k in firsts]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([digests[k] for k in firsts], pa.binary()), "n_tokens": pa.array(counts, pa.int64())})

    return run


def token_counts(df: DataFrame, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, normalise=lambda c: c) -> DataFrame:
    """id, n_bytes, n_tokens. cache: a Parquet folder, by version and run, that is read if it exists and appended to; unset,
    one for this call."""
    spark = df.sparkSession
    ship(spark)
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    version = tokenizer_version(model)
    cache = cache or scratch(spark, "token-cache")

    # Counts of other contents than the given one would be wrong, so what is encoded is the normalised content itself.
    content = F.coalesce(normalise(F.col(f"`{text_col}`")), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    rows = checkpointed(df.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_bytes"), digest.alias("digest")))
    asked = rows.groupBy("digest").agg(F.count("*").alias("n"))
    texts = df.select(digest.alias("digest"), content.alias("text")).mapInArrow(_distinct_in_task, "digest binary, text string")
    known = None
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that there is a folder to read
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    if not stored.isEmpty():
        # The cache meets the digests that are asked for once; a digest that is stored twice has one count.
        known = checkpointed(stored.join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    run = f"{cache}/version={version}/run={uuid.uuid4().hex}"
    texts.repartition("digest").sortWithinPartitions("digest").mapInArrow(_count_runs(model), "digest binary, n_tokens long").write.parquet(run)
    new = spark.read.schema("digest binary, n_tokens long").parquet(run)
    counts = new if known is None else known.unionByName(new)
    facts = checkpointed(asked.join(counts, "digest"))
    return join_hot(rows, facts, "digest", hot_share(spark, rows.count())).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op10(df: DataFrame) -> DataFrame:
    return token_counts(df).withColumn("over_limit", F.col("n_tokens") > LIMIT)
