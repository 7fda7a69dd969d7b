"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from linkloom.llm import byte_bpe, chat_format, exact_dedup, kneser_ney, language_id, mixing, quality_rules, simhash, substring_dedup, token_counts
from linkloom.llm.common import documents


def _conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


QUERIES = {
    "op1_mixing": lambda spark, sf_dir: mixing.op1(documents(spark, sf_dir)),
    "op2_byte_bpe": lambda spark, sf_dir: byte_bpe.op2(documents(spark, sf_dir)),
    "op3_chat_format": lambda spark, sf_dir: chat_format.op3(_conversations(spark, sf_dir)),
    "op4_substring_dedup": lambda spark, sf_dir: substring_dedup.op4(documents(spark, sf_dir)),
    "op5_exact_dedup": lambda spark, sf_dir: exact_dedup.op5(documents(spark, sf_dir)),
    "op6_language_id": lambda spark, sf_dir: language_id.op6(documents(spark, sf_dir)),
    "op7_kneser_ney": lambda spark, sf_dir: kneser_ney.op7(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op8_simhash": lambda spark, sf_dir: simhash.op8(documents(spark, sf_dir)),
    "op9_quality_rules": lambda spark, sf_dir: quality_rules.op9(documents(spark, sf_dir)),
    "op10_token_counts": lambda spark, sf_dir: token_counts.op10(documents(spark, sf_dir)),
}

ORACLE = {
    "op3_chat_format": chat_format.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
}
