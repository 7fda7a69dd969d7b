import pytest
from pyspark.sql import functions as F

from linkloom.operators import blocking, diagnose, evaluate, features, model, postings, split
from linkloom.plans import fixtures
from linkloom.plans.params import CAPS, F2, MAX_DF
from linkloom.sources import sinks, tables
from linkloom.streaming.incremental import stream_candidates

REC = "entity_id string, src int, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def rec(spark, sf):
    return fixtures.records(spark, sf).cache()


def pairs(df):
    return {(r[0], r[1]) for r in df.select("s1_id", "cand_id").collect()}


def test_layers_by_hand(spark):
    rec = spark.createDataFrame([
        ("S1-1", 1, "Acme Widgets", "12 Main Street", "US"), ("S2-1", 2, "ACME, widgets", "9 Elm", "FR"), ("S2-2", 2, "Widgets Intl", "12 High Road", "US"),
        ("S3-1", 3, "Widgets Other", "99 Main Avenue", "US"), ("S3-2", 3, "Widgets Other", "12 Main", "FR"), ("S1-2", 1, None, None, None), ("S2-3", 2, "", "", ""),
    ], REC)
    assert pairs(blocking.exact_name(rec)) == {("S1-1", "S2-1")}
    assert pairs(blocking.exact_basic_name(rec)) == {("S1-2", "S2-3")}
    # acme is the rarest token, which only S2-1 has; with two anchors widgets counts too
    assert pairs(blocking.v1(rec)) == {("S1-1", "S2-1")}
    assert pairs(blocking.v2(rec)) == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S3-1")}


def test_repeated_tokens_take_both_places(spark):
    rec = spark.createDataFrame([("S1-1", 1, "acme acme food", "1 x", "US"), ("S2-1", 2, "food hall", "1 y", "US"), ("S2-2", 2, "acme hall", "2 y", "US"), ("S3-1", 3, "food truck", "7 y", "US")], REC)
    assert pairs(blocking.v2(rec)) == set()
    assert pairs(blocking.v3(rec)) == {("S1-1", "S2-1")}


def test_monotone_in_anchors(rec):
    v1 = pairs(blocking.v1(rec, max_df=MAX_DF))
    v3 = pairs(blocking.v3(rec, max_df=MAX_DF))
    assert v1 <= v3
    assert pairs(blocking.union(blocking.v1(rec, max_df=MAX_DF), blocking.address_tokens(rec, **F2))) >= v1
    assert pairs(blocking.exact_name(rec)) <= pairs(blocking.bounded(rec, max_df=MAX_DF, **CAPS))


def test_registered_blockers_keep_large_groups(spark, tmp_path):
    """80 copies of a record are candidates of each of 40; small caps, asked for, bind."""
    from linkloom.plans.queries import QUERIES

    words = "alder birch cedar dogwood elder " * 8
    rows = [(k, f"{words[:36]}{words}{k}", "en", "s", 7) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rec = fixtures.records(spark, str(tmp_path)).withColumn("business_name", F.concat("business_name", F.lit(" "), "entity_id")).withColumn("business_address", F.lit("hazel road")).cache()
    every = {(f"S1-{a}", f"S{b % 3 + 1}-{b}") for a in range(0, 120, 3) for b in range(120) if b % 3}
    for name in ("block_token2", "block_country_token1", "block_country_token2"):
        assert pairs(QUERIES[name](spark, str(tmp_path))) == every
    usable = {r.token for r in QUERIES["posting_sizes"](spark, str(tmp_path)).collect()}
    assert "alder" in usable and QUERIES["posting_cap"](spark, str(tmp_path)).groupBy("country", "token").count().agg(F.max("count")).first()[0] == 80
    assert pairs(blocking.v1(rec)) == every and pairs(blocking.v1(rec, max_df=60)) == set()
    assert len(pairs(blocking.v1(rec, posting_cap=20))) == 40 * 20
    assert len(pairs(blocking.bounded(rec, max_df=60, address_cap=5))) == 40 * 5


def test_empty_tables(spark):
    rec = spark.createDataFrame([], REC)
    for edges in (blocking.v1(rec), blocking.v2(rec), blocking.bounded(rec), blocking.address_tokens(rec), blocking.purged_address_tokens(rec)):
        assert edges.count() == 0
    spine = spark.createDataFrame([], "s1_id string")
    edges = spark.createDataFrame([], "s1_id string, cand_id string")
    assert evaluate.entity_scores(spine, edges, edges).count() == 0
    assert evaluate.blocking_recall(spine, edges, edges).first()["recall"] == 0.0
    assert split.split(spine).count() == 0


def test_entity_scores(spark):
    spine = spark.createDataFrame([(x,) for x in "abcde"], "s1_id string")
    truth = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1"), ("e", "1")], "s1_id string, cand_id string")
    pred = spark.createDataFrame([("b", "9"), ("c", "1"), ("c", "3"), ("e", "1"), ("zz", "1"), ("e", "1")], "s1_id string, cand_id string")
    got = {r.s1_id: (r.n_true, r.n_pred, r.precision, r.recall, r.f0_5) for r in evaluate.entity_scores(spine, truth, pred).collect()}
    assert got == {"a": (0, 0, 1, 1, 1), "b": (0, 1, 0, 1, 0), "c": (2, 2, 0.5, 0.5, 0.5), "d": (1, 0, 0, 0, 0), "e": (1, 1, 1, 1, 1)}
    kinds = {r.s1_id: r.category for r in evaluate.bucketed(evaluate.entity_scores(spine, truth, pred)).collect()}
    assert kinds == {"a": "singleton_correct", "b": "singleton_false_positive", "c": "nonsingleton_mixed_errors", "d": "nonsingleton_total_miss", "e": "nonsingleton_correct"}


def test_report_and_checked_union(spark):
    spine = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    edges = spark.createDataFrame([("a", "1"), ("a", "2")], "s1_id string, cand_id string")
    scored = edges.withColumn("score", F.lit(0.7))
    out = evaluate.report(spine, edges, edges, edges, scored)
    assert set(out) == {"blocking_recall", "scores", "macro", "buckets", "sweep", "best"}
    assert out["best"].first()["macro_f0_5"] == 1.0 and out["best"].first()["threshold"] == 0.1
    assert blocking.checked_union(spine, edges, edges).count() == 2
    with pytest.raises(Exception, match="unknown S1 entity: a"):
        blocking.checked_union(spine.where("s1_id = 'b'"), edges).collect()
    counts = evaluate.entity_counts(spine, edges.limit(1), edges)
    assert diagnose.overmatch_report(counts, edges, edges.limit(1), scored, scored.withColumnRenamed("score", "x")).columns == ["s1_id", "cand_id", "score", "x", "match_type"]


def test_thresholds():
    assert evaluate.thresholds("0.10", "0.90", "0.05") == [round(0.1 + 0.05 * i, 4) for i in range(17)]


def test_invariants_find_violations(spark):
    spine = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    cand = spark.createDataFrame([("a", "S2-1")], "s1_id string, cand_id string")
    wide = spark.createDataFrame([("a", "S2-1,S2-1,S2-9"), ("c", "")], "source1_entity_id string, matched_entity_ids string")
    ref = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {r.invariant: r.violations for r in evaluate.invariants(spine, cand, wide, ref).collect()}
    assert got == {"row_per_s1": 1, "unknown_s1": 1, "repeated_ids": 1, "unknown_ids": 1, "not_candidates": 1}


def test_split_is_exact(spark):
    spine = spark.range(1013).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    parts = split.split(spine, 0.15)
    assert parts.where("part = 'validation'").count() == 151 and parts.count() == 1013
    again = split.split(spine.repartition(5), 0.15)
    assert parts.exceptAll(again).count() == 0


def test_negatives(spark):
    rows = spark.range(500).select(F.concat(F.lit("a"), "id").alias("s1_id"), F.lit("x").alias("cand_id"), (F.col("id") < 20).cast("int").alias("label"))
    got = split.sample_negatives(rows)
    assert (got.where("label = 1").count(), got.where("label = 0").count()) == (20, 60)
    assert split.sample_negatives(rows.where("label = 0")).count() == 1


def test_missed_and_missing(spark):
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "9")], "s1_id string, cand_id string")
    edges = spark.createDataFrame([("a", "1")], "s1_id string, cand_id string")
    ref = spark.createDataFrame([("1",), ("2",)], "entity_id string")
    assert pairs(diagnose.missed_pairs(truth, edges, ref)) == {("a", "2")}
    records = spark.createDataFrame([("a",), ("1",)], "entity_id string")
    assert features.missing_records(truth, records).first()[0] == 2


def test_diagnostic_report(spark, rec):
    missed = fixtures.truth(rec)
    from linkloom.operators.postings import prepared

    found = diagnose.miss_features(missed, prepared(rec))
    assert found.count() == missed.count()
    profile = {r.predicate: r.pairs for r in diagnose.miss_profile(found).collect()}
    assert len(profile) == 19 and profile["name_ratio_80"] >= profile["name_ratio_95"]
    assert diagnose.describe(found, ["name_ratio", "name_jaccard"]).count() == 2


def test_model_round_trip(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("a"), "id").alias("s1_id"), F.lit("x").alias("cand_id"), *[((F.col("id") % 7) / (k + 1)).alias(c) for k, c in enumerate(features.FEATURES)], (F.col("id") % 7 > 3).cast("int").alias("label"))
    fitted = model.fit(rows, trees=3, depth=2, least=1)
    model.save(fitted, str(tmp_path / "m"))
    scored = model.score(model.load(str(tmp_path / "m")), rows).join(rows.select("s1_id", "label"), "s1_id")
    assert scored.where((F.col("score") > 0.5) != (F.col("label") == 1)).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tUS\nS2-7\tnull\t"a b"\t\n')
    df = tables.read_source(spark, str(tmp_path / "s.tsv"))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", "NA", "", "US", 1), ("S2-7", "null", "a b", "", 2)]
    spine = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    edges = spark.createDataFrame([("a", "2"), ("a", "1")], "s1_id string, cand_id string")
    sinks.write_lists(spine, edges, str(tmp_path / "out"))
    back = tables.read_tsv(spark, str(tmp_path / "out"), tables.schema.CANDIDATES)
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1,2"), ("b", "")]
    assert pairs(tables.edges(back)) == {("a", "1"), ("a", "2")} and tables.spine(back).count() == 2
    with pytest.raises(ValueError):
        tables.match_column(spine)
    sinks.write_parquet(edges, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p"), columns=["s1_id"]).columns == ["s1_id"]


def test_stream_equals_batch(spark, rec, tmp_path):
    columns = ["entity_id", "src", "business_name", "business_address", "country"]
    s1, ref = rec.where("src = 1").select(*columns), rec.where("src <> 1").select(*columns)
    s1.repartition(3).write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = set()
    stream_candidates(arrivals, ref, blocking.exact_name, lambda edges, n: found.update(pairs(edges)), str(tmp_path / "cp")).awaitTermination()
    assert found == pairs(blocking.exact_name(rec))


@pytest.mark.parametrize("salts", [1, 7])
def test_large_caps_cut_salts_first(spark, monkeypatch, salts):
    """A skewed token, a cap beyond what Spark prunes: the first rows, by way of several tasks."""
    monkeypatch.setattr(postings, "PRUNED", 10)
    monkeypatch.setattr(postings, "SALTS", salts)
    rows = spark.range(3000).select(F.concat(F.lit("S2-"), F.col("id") % 1500).alias("entity_id"), (F.col("id") % 2 + 2).alias("src"), F.lit("us").alias("country"), F.when(F.col("id") % 50 == 0, "rare").otherwise("street").alias("token"))
    want = sorted((r.src, r.entity_id) for r in rows.where("token = 'street'").collect())[:100]
    out = postings.capped(rows, 100)
    assert sorted((r.src, r.entity_id) for r in out.where("token = 'street'").collect()) == want
    assert out.where("token = 'rare'").count() == 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RowNumber") >= 2 or plan.count("Window [") == 2


def test_default_caps_are_salted(rec):
    plan = postings.capped(postings.exploded(postings.prepared(rec), F.split("addr", " ")), postings.BlockConfig.posting_cap)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and plan.count("Window [") == 2


def test_sweep_equals_scores_at_each_threshold(spark):
    import random

    rnd = random.Random(3)
    spine = spark.createDataFrame([(f"s{k}",) for k in range(40)], "s1_id string")
    truth = spark.createDataFrame([(f"s{rnd.randrange(45)}", f"c{rnd.randrange(5)}") for _ in range(60)], "s1_id string, cand_id string")
    pairs_ = {(f"s{rnd.randrange(45)}", f"c{rnd.randrange(5)}"): rnd.choice([0.05, 0.1, 0.3, 0.5, 0.77, 1.0]) for _ in range(120)}
    scored = spark.createDataFrame([(*k, v) for k, v in pairs_.items()], "s1_id string, cand_id string, score double")
    steps = [0.1, 0.3, 0.4, 0.9, 1.01]
    swept = evaluate.sweep(spine, truth, scored, steps)
    got = {r.threshold: (r.macro_f0_5, r.macro_precision, r.macro_recall) for r in swept.collect()}
    for t in steps:
        m = evaluate.macro(evaluate.entity_scores(spine, truth, evaluate.predictions(scored, t))).where("part = 'all'").first()
        assert got[t] == pytest.approx((m.macro_f0_5, m.macro_precision, m.macro_recall), abs=1e-6)
    assert "Generate" not in swept._jdf.queryExecution().optimizedPlan().toString()


def test_describe_by_hand(spark):
    import numpy as np

    rows = spark.createDataFrame([(float(x) ** 2 % 13, None if x % 5 == 0 else float(x), 7.0) for x in range(101)], "a double, b double, c double")
    out = {r.column: r for r in diagnose.describe(rows, ["a", "b", "c"]).collect()}
    for k, c in enumerate("abc"):
        v = np.array([r[k] for r in rows.collect() if r[k] is not None])
        r = out[c]
        assert (r.n, r.min, r.max) == (len(v), v.min(), v.max())
        assert (r["mean"], r["std"]) == pytest.approx((v.mean(), v.std(ddof=1)), abs=1e-5)
        assert [r[f"p{p:02d}"] for p in (1, 25, 50, 95)] == pytest.approx(np.percentile(v, [1, 25, 50, 95]).tolist(), abs=1e-5)


def test_split_extremes(spark):
    spine = spark.range(40).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    for fraction, n in ((0.0, 0), (0.01, 0), (0.5, 20), (1.0, 40)):
        assert split.split(spine, fraction).where("part = 'validation'").count() == n


def test_errors_are_written_worst_first(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("s"), "id").alias("s1_id"), ((F.col("id") * 7919 % 100) / 100).alias("f0_5")).repartition(7)
    sinks.write_errors(rows, str(tmp_path / "e"))
    lines = [line.split("\t") for f in sorted((tmp_path / "e").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert len(lines) == 200 and [float(x[1]) for x in lines] == sorted(float(x[1]) for x in lines)


def test_pandas_reads_what_is_written(spark, tmp_path):
    import pandas as pd

    rows = list(fixtures.AWKWARD)
    sinks.write_tsv(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), str(tmp_path / "t"), files=1)
    (file,) = (tmp_path / "t").glob("part-*")
    back = pd.read_csv(file, sep="\t", dtype=str, keep_default_na=False)
    assert sorted(map(tuple, back.to_numpy().tolist())) == sorted(rows)
    back.to_csv(tmp_path / "p.tsv", sep="\t", index=False)
    again = tables.read_source(spark, str(tmp_path / "p.tsv")).drop("src")
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_pairs_of_large_keys_are_dealt_out(spark, monkeypatch):
    """A large name's pairs are made by many tasks, each pair once and with both of its rows; what is evaluated from tallies
    is what is evaluated from pairs."""
    monkeypatch.setattr(blocking, "SIDE", 8)
    monkeypatch.setattr(blocking, "TASK", 100)
    rows = [(f"S{k % 3 + 1}-{k}", k % 3 + 1, "one large name" if k < 120 else f"name number{k // 2}", f"{k % 5} street{k % 7} road", "en") for k in range(150)]
    rows += [("S1-900", 1, "", "", None), ("S2-901", 2, None, None, "en")]
    records = spark.createDataFrame(rows, "entity_id string, src int, business_name string, business_address string, country string")
    carry = records.select("entity_id", "business_name")
    found = blocking.v1(records, carry)
    pairs = [(r.s1_id, r.cand_id) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and {p for p in pairs if int(p[0][3:]) < 120} >= {(f"S1-{a}", f"S{b % 3 + 1}-{b}") for a in range(0, 120, 3) for b in range(120) if b % 3}
    assert sorted(pairs) == sorted((r.s1_id, r.cand_id) for r in blocking.v1(records).collect())
    names = {r[0]: r[2] for r in rows}
    assert all(r.a.business_name == names[r.s1_id] and r.b.business_name == names[r.cand_id] for r in found.collect())
    sizes = found.rdd.glom().map(len).collect()
    assert max(sizes) < len(pairs) / 4
    twice = records.unionAll(records.where("entity_id = 'S1-3'"))  # an identifier that two records share
    assert sorted((r.s1_id, r.cand_id) for r in blocking.v1(twice).collect()) == sorted(pairs)
    scored = found.select("s1_id", "cand_id", (F.abs(F.hash("s1_id", "cand_id")) % 10 / 10).alias("score")).cache()
    truth = scored.where("hash(cand_id, s1_id) % 4 = 0").select("s1_id", "cand_id").unionAll(spark.createDataFrame([("S1-900", "S2-901"), ("S1-0", "S2-901")], "s1_id string, cand_id string"))
    spine, steps = records.where("src = 1").select(F.col("entity_id").alias("s1_id")), [0.2, 0.5, 0.8]
    true, tallies = evaluate.true_counts(truth), evaluate.tallied(features.labelled(scored, truth), steps, 0.5)
    want = evaluate.report(spine, truth, scored, evaluate.predictions(scored, 0.5), scored, steps)
    for name, df in evaluate.report_tallied(spine, true, tallies, steps).items():
        assert sorted(map(str, df.collect())) == sorted(map(str, want[name].collect())), name
