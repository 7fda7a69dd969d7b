import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} {kind}" for k in range(len(values[0]))))
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def texts(spark, values, f):
    return one(spark, [(v,) for v in values], f(F.col("c0")))


def test_ascii_and_basic(spark):
    assert texts(spark, ["A&B Foods, Inc.", "  Café  ", None, "日本"], N.ascii_text) == ["aandb foods inc", "caf", "", ""]
    assert texts(spark, [" A & B. ", None, "x  y"], N.basic) == ["a and b.", "", "x  y"]


def test_canonical_name(spark):
    given_ = ["A&B Foods, Inc.", "Acme L.L.C.", "Acme Pvt. Ltd.", "Company", "हिन्दी", "ＡＣＭＥ Ltd", None, "a_b"]
    names = texts(spark, given_, N.canonical_name)
    assert names == ["a and b foods inc", "acme l l c", "acme pvt ltd", "company", "ह न द", "acme ltd", "", "a_b"]
    assert texts(spark, names, N.legal_suffix) == ["inc", "", "pvt ltd", "company", "", "ltd", "", ""]
    assert texts(spark, names, lambda c: N.name_core(c, N.legal_suffix(c))) == ["a and b foods", "acme l l c", "acme", "", "ह न द", "acme", "", "a_b"]


def test_canonical_address_and_country(spark):
    assert texts(spark, ["12, Main St. #4", "N St. Mary", None, "Avenue drst"], N.canonical_address) == ["12 main street #4", "north street mary", "", "avenue drst"]
    assert texts(spark, ["cote d'ivoire", "xx", "USA", "u.s.a.", " Great  Britain ", None, ""], N.canonical_country) == ["Cote D'Ivoire", "XX", "US", "US", "GB", "", ""]


def test_numbers(spark):
    assert texts(spark, ["a 12b c 7", "12th street", "none", None], N.first_number) == ["12b", "", "", ""]
    assert texts(spark, ["सड़क १२ x", "12 main", "x12"], N.first_number_unicode) == ["१२", "12", ""]


def test_tokens(spark):
    assert texts(spark, ["acme acme foo", "", None], lambda c: N.tokens(N.text(c), 4)) == [["acme"], [], []]
    assert texts(spark, ["acme acme foo"], lambda c: N.tokens(c, 4, distinct=False)) == [["acme", "acme"]]
    assert texts(spark, ["café 1 ab"], N.alnum_tokens) == [["caf", "ab"]]
    assert texts(spark, ["a, b;,c", "", None], lambda c: N.id_list(c, ",;")) == [["a", "b", "c"], [], []]


def test_set_similarities(spark):
    pairs = [("", ""), ("a", ""), ("a b", "b c"), ("a b", "a b c d")]
    sets = (N.tokens(F.col("c0")), N.tokens(F.col("c1")))
    assert one(spark, pairs, S.jaccard(*sets)) == [1.0, 0.0, pytest.approx(1 / 3), 0.5]
    assert one(spark, pairs, S.overlap(*sets)) == [0.0, 0.0, 0.5, 1.0]
    assert one(spark, [("", ""), ("a", "a"), ("a", "b")], S.equal(F.col("c0"), F.col("c1"))) == [0.0, 1.0, 0.0]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=90))
def test_common_length(a, b):
    assert S.common_length(a, b) == lcs(a, b) == S.common_length(b, a)


def test_ratios(spark):
    pairs = [("", ""), ("acme corp", "acme corporation"), ("a", ""), ("same", "same")]
    assert one(spark, pairs, S.ratio(F.col("c0"), F.col("c1"))) == [1.0, pytest.approx(18 / 25), 0.0, 1.0]
    assert one(spark, pairs, S.matching_blocks_ratio(F.col("c0"), F.col("c1"))) == [pytest.approx(difflib.SequenceMatcher(None, a, b).ratio()) for a, b in pairs]


def test_common_lengths_of_many_pairs():
    import random

    from linkloom.functions import similarity

    rnd = random.Random(1)
    text = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(190)))
    a, b = [text("abcé\U0001F600 ") for _ in range(300)] + ["", "x", ""], [text("abcdé ") for _ in range(300)] + ["", "", "y"]
    assert similarity.common_lengths(a, b).tolist() == [similarity.common_length(x, y) for x, y in zip(a, b)]
    assert similarity.common_lengths([], []).tolist() == []
