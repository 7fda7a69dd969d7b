"""Sources: tab-separated and Parquet tables, as typed DataFrames. Missing text is empty, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom import schema
from linkloom.functions.normalize import id_list

MATCH_COLUMNS = ("matched_entity_ids", "matched_ids", "candidate_entity_ids")


def read_tsv(spark: SparkSession, path: str | list[str], kind: T.StructType = schema.SOURCE, tolerant: bool = False, line_breaks: bool = True) -> DataFrame:
    """All columns as declared; quotes inside quoted texts are doubled. tolerant: rows that don't parse are left out, else
    they raise. line_breaks: quoted texts may hold line breaks; without them, large files are read in many tasks."""
    reader = spark.read.schema(kind).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").option("quote", '"').option("escape", '"').option("enforceSchema", False)
    df = reader.option("multiLine", line_breaks).csv(path)
    return df.na.fill("", [f.name for f in kind if isinstance(f.dataType, T.StringType)])


def read_source(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records with src, from the prefix of their identifiers."""
    return read_tsv(spark, path).withColumn("src", F.regexp_extract("entity_id", r"^S(\d+)-", 1).cast("long"))


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a table of this name, or a folder or file at this path that Spark can list."""
    if "/" not in name:
        return spark.catalog.tableExists(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def match_column(df: DataFrame) -> str:
    """The column that lists identifiers; raises if there is none."""
    for name in MATCH_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(MATCH_COLUMNS)} in {df.columns}")


def edges(df: DataFrame, separators: str = ",;") -> DataFrame:
    """A wide table (one list for each S1 entity) as edges."""
    if "source1_entity_id" not in df.columns:
        raise ValueError(f"no source1_entity_id in {df.columns}")
    ids = id_list(F.col(match_column(df)), separators)
    return df.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("cand_id")).distinct()


def spine(df: DataFrame) -> DataFrame:
    return df.select(F.col("source1_entity_id").alias("s1_id")).distinct()
