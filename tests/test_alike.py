"""Features of pairs of equal names, block by block, against the same pairs row by row."""

import random
import time

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity
from linkloom.operators import alike, blocking, features, model, split
from linkloom.operators.postings import prepared
from linkloom.plans import queries
from linkloom.schema import FEATURES


def _text(chars, most, least=0):
    return "".join(random.choice(chars) for _ in range(random.randint(least, most)))


@pytest.mark.parametrize("table", [similarity.TABLE, 200])
@pytest.mark.parametrize("chars", ["a", "ab", "abcdefgh ", "".join(map(chr, range(300, 900))), "a\U0001f600é"])
def test_subsequence_lengths(chars, table, monkeypatch):
    monkeypatch.setattr(similarity, "TABLE", table)
    monkeypatch.setattr(similarity, "AT_ONCE", 100)
    random.seed(3)
    texts = [_text(chars, n + 1, n - 1) for n in (1, 30, 62, 63, 64, 125, 126, 127, 189, 190, 191, 260) for _ in range(4)]
    texts += ["", "a\0", "\0"]
    i, j = np.random.default_rng(5).integers(0, len(texts), (2, 2000))
    assert similarity.subsequence_lengths(texts, i, j).tolist() == [similarity.common_length(texts[p], texts[q]) for p, q in zip(i, j)]


def test_masks_are_made_once_for_all_pairs_of_a_text():
    random.seed(4)
    texts = [_text("abcdefghijklmnopqrstuvwxyz ", 67, 60) for _ in range(1000)]
    i, j = np.repeat(np.arange(500), 500), np.tile(np.arange(500, 1000), 500)
    began = time.process_time()
    found = similarity.subsequence_lengths(texts, i, j)
    assert time.process_time() - began < 1.0  # 2.1 s when each pair had masks of its own, 0.1 s as it is
    assert found[:50].tolist() == [similarity.common_length(texts[p], texts[q]) for p, q in zip(i[:50], j[:50])]


@pytest.fixture(scope="module")
def records(spark):
    """Names that are equal in ASCII form alone, and one of more records than a block's side."""
    random.seed(7)
    words = ["main", "st", "north", "12", "7b", "a", "und der", "été", "#4"]
    rows = []
    for k in range(blocking.SIDE + 150):
        src, name = (1, "Acme Inc") if k < blocking.SIDE + 60 else (random.choice((1, 2, 3)), random.choice(["Acme Inc", "acme, inc.", "Acmé Inc", "acm  inc", "acme é inc", "", "Other & Co", "Otherand Co", "Zed"]))
        rows.append((f"S{src}-{k}", src, name, " ".join(random.choices(words, k=random.randint(0, 6))), random.choice(["US", "usa", "", None, "DE"])))
    rows += [("S1-9000", 1, "Long", "x " + "ab cd ef " * 30, "US"), ("S2-9001", 2, "Long", " ".join(f"w{k}" for k in range(90)), "US"), ("S2-9002", 2, "Long", "y " + "ab cd ef " * 30, "FR"), ("S3-9003", 3, "Long", None, "FR")]
    rows += [("S1-9004", 1, "Inc", "a", "US"), ("S2-9005", 2, "inc.", "a", "US"), ("S3-9006", 3, "Inc é", "b\0", "US")]
    return spark.createDataFrame(rows, "entity_id string, src int, business_name string, business_address string, country string").cache()


def test_features_by_blocks(records):
    canon, rows = features.canonical_records(records), prepared(records)
    both = rows.select("entity_id", "src", "name").join(canon.withColumnRenamed("name", "canonical"), "entity_id")
    found = alike.featured(blocking.named_alike(both, carry=alike.CARRIED))
    plain = features.pair_features(blocking.exact_name(records), canon)
    assert found.columns == plain.columns == ["s1_id", "cand_id", *FEATURES]
    assert [f.dataType for f in found.schema] == [f.dataType for f in plain.schema]
    assert rows_of(found) == rows_of(plain) and plain.count() > 10_000 and plain.where("name_exact = 0").count() > 100


@pytest.fixture(scope="module")
def labelled(records):
    """Blocks with true keys, some empty, and the same pairs row by row with their labels."""
    canon = features.canonical_records(records).withColumn("truth", F.when(F.xxhash64("entity_id") % 3 != 0, F.concat(F.lit("k"), F.xxhash64("entity_id") % 40)).otherwise(""))
    both = prepared(records).select("entity_id", "src", "name").join(canon.withColumnRenamed("name", "canonical"), "entity_id")
    rows = features.with_records(blocking.exact_name(records), canon)
    return blocking.named_alike(both, carry=(*alike.CARRIED, "truth")), features.compared(rows, similarity.equal(F.col("a.truth"), F.col("b.truth")).cast("int").alias("label")).cache()


@pytest.mark.parametrize("per_positive", [3, 1000])
def test_sample_by_blocks(labelled, per_positive):
    blocks, plain = labelled
    bins = alike.binned(blocks, 42)
    own = F.when(F.col("label") == 1, -1).otherwise(split.digest_bin(42, "s1_id", "cand_id"))
    assert rows_of(bins.groupBy("bin").agg(F.sum("n").alias("n"))) == rows_of(plain.groupBy(own.alias("bin")).agg(F.count("*").alias("n")))
    some = alike.labelled(blocks, 42, split.last_bin(bins, per_positive))
    assert rows_of(split.sample_negatives(some, per_positive)) == rows_of(split.sample_negatives(plain, per_positive))
    assert 50 < plain.where("label = 1").count() < some.count() and (some.count() < plain.count()) == (per_positive == 3)


def test_equal_features_are_scored_once(labelled):
    blocks, plain = labelled
    rows = alike.grouped(blocks)
    assert rows_of(rows.select(F.inline("pairs"), *FEATURES)) == rows_of(plain.drop("label")) and rows.count() < plain.count() / 2
    fitted = model.fit(plain, trees=3, depth=3, least=2)
    assert rows_of(model.scored(fitted, rows).select(F.inline("pairs"), "score")) == rows_of(model.score(fitted, plain))


def test_distinct_rows_of_one_mixed_number(monkeypatch):
    """Kinds that are mixed into one number are told apart."""
    columns = [np.array([0.0, 1.0, 0.0, 1.0, -0.0]), np.array([0.5, 0.5, 0.25, 0.5, 0.5])]
    plain = alike._distinct(columns)
    unique = np.unique
    monkeypatch.setattr(alike.np, "unique", lambda x, **how: unique(np.zeros_like(x) if x.ndim == 1 else x, **how))
    for first, code in (plain, alike._distinct(columns)):
        assert len(first) == 3 and all((c[first[code]] == c).all() for c in columns)


@pytest.mark.parametrize("query", ["gbt_scores", "gbt_expression"])
def test_models_store_no_list_of_all_pairs(spark, sf, query, monkeypatch):
    """What is stored has features of the sampled pairs and of the few of other layers alone."""
    kept, stored = queries.kept, []

    def watched(df: DataFrame) -> DataFrame:
        out = kept(df)
        if "address_ratio" in df.columns:
            stored.append(out.count())
        return out

    monkeypatch.setattr(queries, "kept", watched)
    found = queries.QUERIES[query](spark, sf)
    pairs = queries.QUERIES["block_union"](spark, sf)
    assert rows_of(found.select("s1_id", "cand_id")) == rows_of(pairs) and max(stored, default=0) < pairs.count()
