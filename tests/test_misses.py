"""Missed pairs of equal names, block by block, against the same pairs row by row."""

import difflib
import random

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from linkloom.functions import matching
from linkloom.operators import blocking, diagnose, misses
from linkloom.operators.postings import prepared


def _text(chars, most, least=0):
    return "".join(random.choice(chars) for _ in range(random.randint(least, most)))


@pytest.mark.parametrize("chars", ["a", "ab", "abcdefgh ", "".join(map(chr, range(300, 900)))])
def test_matching_lengths(chars):
    random.seed(3)
    texts = [_text(chars, 60) for _ in range(30)]
    texts += [_text(chars, 3) + t[random.randint(0, 4) :] + _text(chars, 30) for t in texts for _ in range(4)]
    texts += ["", "a\0", _text(chars, 260, 200), _text(chars, 260, 200)]
    shared = _text(chars, 50, 35)
    texts += [_text(chars, 2) + shared + _text(chars, 20) for _ in range(60)]
    i, j = np.random.default_rng(5).integers(0, len(texts), (2, 3000))
    i[1500:], j[1500:] = len(texts) - 60 + i[1500:] % 60, len(texts) - 60 + j[1500:] % 60
    plain = [sum(x.size for x in difflib.SequenceMatcher(None, texts[p], texts[q]).get_matching_blocks()) for p, q in zip(i, j)]
    assert matching.matching_lengths(texts, i, j).tolist() == plain


@pytest.fixture(scope="module")
def alike(spark):
    """Blocks of some records, and the features of the same pairs row by row; one name has more records than a block's side."""
    random.seed(7)
    words = ["main", "street", "north", "12", "7b", "a", "und der", "été"]
    rows = []
    for k in range(blocking.SIDE + 200):
        src, name = (1, "Acme Inc") if k < blocking.SIDE + 88 else (random.choice((1, 2, 3)), random.choice(["Acme Inc", "acme, inc.", "", "Other Ltd", "Zed"]))
        rows.append((f"S{src}-{k}", src, name, " ".join(random.choices(words, k=random.randint(0, 6))), random.choice(["US", "us", "", "DE"])))
    rows += [("S1-9000", 1, "Long", "x " + "ab cd ef " * 30, "US"), ("S2-9001", 2, "Long", " ".join(f"w{k}" for k in range(90)), "US"), ("S2-9002", 2, "Long", "x " + "ab cd ef " * 30, "FR")]
    nrm = prepared(spark.createDataFrame(rows, "entity_id string, src int, business_name string, business_address string, country string")).cache()
    s1, ref = nrm.where("src = 1 and name <> ''"), nrm.where("src <> 1")
    pairs = s1.select(F.col("entity_id").alias("s1_id"), "name").join(ref.select(F.col("entity_id").alias("cand_id"), "name"), "name").select("s1_id", "cand_id")
    gone = pairs.where("pmod(xxhash64(s1_id, cand_id), 3) = 0").unionAll(spark.createDataFrame([("S1-9000", "S9-1"), ("S1-0", "S2-9001")], "s1_id string, cand_id string")).cache()
    return blocking.named_alike(nrm, gone), diagnose.miss_features(pairs.join(gone, ["s1_id", "cand_id"], "left_anti"), nrm).cache()


def test_values_by_blocks(alike):
    blocks, plain = alike
    columns = ["name_ratio", "address_ratio", "address_jaccard", "address_overlap", "shared_address_tokens"]
    assert rows_of(diagnose.described(misses.value_counts(blocks, columns))) == rows_of(diagnose.describe(plain, columns))


def test_rows_by_blocks(alike):
    blocks, plain = alike
    found = misses.listed(blocks)
    assert [f.dataType for f in found.schema] == [f.dataType for f in plain.schema] and found.columns == plain.columns
    assert rows_of(found) == rows_of(plain) and plain.count() > 10_000


def test_profile_by_blocks(alike):
    blocks, plain = alike
    assert rows_of(diagnose.profiled(misses.predicate_counts(blocks, diagnose.MISS_PREDICATES))) == rows_of(diagnose.miss_profile(plain))
