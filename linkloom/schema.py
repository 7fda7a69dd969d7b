"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T


def _of(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


# Columns of the files.
SOURCE = _of(entity_id=T.StringType(), business_name=T.StringType(), business_address=T.StringType(), country=T.StringType())
TRUTH = _of(source1_entity_id=T.StringType(), matched_entity_ids=T.StringType())
CANDIDATES = _of(source1_entity_id=T.StringType(), candidate_entity_ids=T.StringType())
EDGE = _of(s1_id=T.StringType(), cand_id=T.StringType())
SCORES = _of(source1_entity_id=T.StringType(), candidate_entity_id=T.StringType(), score=T.DoubleType())

# The features, in the order that files and models have them.
FEATURES = (
    "name_exact", "name_core_exact", "name_jaccard", "name_overlap", "name_ratio",
    "address_exact", "address_jaccard", "address_overlap", "address_ratio",
    "address_number_equal", "country_equal", "name_address_mean", "name_address_min",
)
