"""What the operators of this subpackage share: words, the shared scratch folder, shipping code to executors."""

from __future__ import annotations

import gc
import math
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same class in Java's, Python's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array; empty for null and for blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Of so many folds, one is held out.
FOLDS = 5


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == 0


#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8_000_000


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per SparkContext, and bound the bytes of a batch of texts
    where the session leaves Spark's default; no other setting is touched."""
    sc = spark.sparkContext
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_BYTES))
    if sc in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    stage = tempfile.mkdtemp()
    base = os.path.join(stage, f"linkloom-{uuid.uuid4().hex[:8]}")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "linkloom"))
    _shipped.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, a folder below the
    warehouse, or in local mode a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="checkpoints-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a file, where a table is known to be small, and the least number of files.
ROWS_A_FILE, LEAST_FILES = 100_000, 8


def checkpointed(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared folder; a lost executor costs a read and no recomputation. most: a bound of
    its rows, if one is known; narrow tables of few rows are then kept in few files."""
    shared_dir(df.sparkSession)
    return (df if most is None else df.coalesce(max(LEAST_FILES, most // ROWS_A_FILE))).checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot if it has more rows than this, and more than its share.
HOT_LEAST = 500
#: Rows of two columns of a table that is broadcast at most (some 16 MB).
FEW = 500_000


def hot_share(spark: SparkSession, total: int) -> int:
    """Rows above which a key is hot: fewer than four keys for each partition can have more."""
    return max(HOT_LEAST, math.ceil(total / (4.0 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def join_hot(rows: DataFrame, facts: DataFrame, key: str, share: int) -> DataFrame:
    """rows with the facts of their key: (key, n, ...), n the number of rows of each key, every key of rows among them. Both
    are checkpointed.

    Rows of hot keys stay where they are and meet their facts, which are few, in a broadcast; all others meet theirs in a
    shuffle by key.
    """
    values = [c for c in facts.columns if c not in (key, "n")]
    if facts.where(F.col("n") > share).isEmpty():
        every = facts.select(F.col(key).alias("_key"), *values)
        return rows.join(every, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    hot = facts.where(F.col("n") > share).select(F.col(key).alias("_key"), F.struct(*values).alias("_facts"))
    tagged = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    cold = facts.where(F.col("n") <= share).select(F.col(key).alias("_key"), *values)
    apart = tagged.where(F.col("_facts").isNull()).drop("_facts").join(cold, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return apart.unionByName(tagged.where(F.col("_facts").isNotNull()).select(*rows.columns, *[F.col("_facts").getField(v).alias(v) for v in values]))


def some_of(rows: DataFrame, ids: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """The rows whose key ids (key, each once; checkpointed) has or, if anti, lacks. Broadcast if ids are known to be few, so that rows stay
    where they are."""
    ids = ids.select(F.col(key).alias("_key"))
    ids = F.broadcast(ids) if ids.count() <= FEW else ids
    return rows.join(ids, F.col(key).eqNullSafe(F.col("_key")), "left_anti" if anti else "left_semi")


def trimmed() -> None:
    """Give memory that a task has freed back to the system; a Python worker outlives its tasks."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def swept(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing needs any more, now and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pack(batches):
    """The last column, a text, as zstd-compressed UTF-8: what moves between executors is a third of it."""
    import pyarrow as pa

    for batch in batches:
        packed = []
        for text in batch.columns[-1]:
            text = text.as_py()
            data = None if text is None else text.encode()
            packed.append(None if data is None else len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-1], "packed"])


def unpack(packed: bytes | None) -> bytes:
    import pyarrow as pa

    return b"" if packed is None else pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
