"""Sinks: tab-separated and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.evaluate import error_report, wide


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_tsv(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """A file for each partition, or `files` of them; texts stay as they are, quotes inside quoted ones are doubled."""
    writer = (df.coalesce(files) if files else df).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_lists(spine: DataFrame, edges: DataFrame, path: str, name: str = "candidate_entity_ids") -> None:
    """One row for each S1 entity in order of its identifier, those without a candidate too."""
    write_tsv(wide(spine, edges, name).orderBy("source1_entity_id"), path)


def write_errors(buckets: DataFrame, path: str) -> None:
    """The report of entities and their kind of error, the worst first."""
    write_tsv(error_report(buckets), path)


def latest(rows: DataFrame, key: str = "entity_id", order: tuple = ("src",)) -> DataFrame:
    """An upsert's outcome: of the rows with a key, the last one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")
