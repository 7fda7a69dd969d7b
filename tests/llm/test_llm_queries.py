"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import re
from collections import defaultdict

import pytest
from helpers import rows_of, rows_of_sql

import corpus_pipeline
from linkloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    assert rows_of(df) == rows_of_sql(duck, ORACLE[name], sorted(df.columns))


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


def plain_near(texts, shingle=5, least=0.8):
    """The least identifier of each group of texts that similar pairs connect."""
    sets = {}
    for k, text in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        sets[k] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}
    root = {k: k for k in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in texts if find(k) == k}


def test_stages_tell_rows_of_one_identifier_apart(spark):
    """Null and repeated identifiers, columns with the names that stages use inside, rows that agree in all columns."""
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, base, "en", "a", 1), (None, base + " tail", "en", "a", 1), (None, other, "en", "a", 1), (7, other + " end", "en", "b", 1), (7, "short text here", "en", "b", 1), (7, "short text here", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS key", "2 AS row", "3 AS copies", "4 AS digest", "5 AS n")
    near = corpus_pipeline.near(spark, docs, "")
    assert near.columns == docs.columns
    out = near.collect()
    assert sorted(r.text for r in out if r.doc_id == 7) == sorted([other + " end", "short text here"])
    assert [r.text.split()[0] for r in out if r.doc_id is None] == ["w0"] and len(out) == 3
    many = spark.createDataFrame([(5, f"{base} {k % 10}", "en", "s", 1) for k in range(50)] + [(k, other, "en", "t", 1) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixed(spark, many, "").collect()
    words = defaultdict(int)
    for r in mixed:
        words[r.source] += len(r.text.split())
    total = 50 * 61 + 50 * 60
    assert words["s"] == pytest.approx(total * 5 / 7, abs=61) and words["t"] == pytest.approx(total * 2 / 7, abs=61)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        rows, kept = before.collect(), after.collect()
        if name == "language":
            assert {r.doc_id for r in rows} - {r.doc_id for r in kept} == {r.doc_id for r in rows if not any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            best = defaultdict(int)
            for r in rows:
                best[r.text or ""] = max(best[r.text or ""], r.doc_id)
            assert {r.doc_id for r in kept} == set(best.values()) and len(kept) == len(best)
        elif name == "near_dedup":
            stays = plain_near({r.doc_id: r.text or "" for r in rows})
            left = {r.doc_id for r in kept}
            gone = {r.doc_id for r in rows} - stays
            assert stays <= left and len(gone & left) <= max(1, 0.1 * len(gone))  # fingerprints may miss a link
        else:
            assert {r.doc_id for r in kept} <= {r.doc_id for r in rows}
        before = after
        sizes.append(len(kept))
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == sizes[-1] and set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256"}


def test_stages_take_odd_rows(spark, odd_rows, none):
    docs = spark.createDataFrame(odd_rows, none.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        docs = stage(spark, docs, "").cache()
        assert docs.count() > 0
