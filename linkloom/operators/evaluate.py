"""Decisions on scored pairs, and their evaluation against the truth.

Everything is counted over the spine of S1 entities, so that those without a candidate, prediction or match count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.shared import kept

#: Decimals of means over entities, which depend on the order of summation beyond them.
DECIMALS = 6


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose score is at least the threshold."""
    return scored.where(F.col("score") >= threshold).select("s1_id", "cand_id")


def wide(spine: DataFrame, edges: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for each S1 entity with its sorted, comma-joined list; empty if it has none."""
    lists = edges.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))
    return spine.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def entity_counts(spine: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, tp) for every S1 entity; predictions for others are ignored."""
    marks = truth.select("s1_id", "cand_id", F.lit(1).alias("t"), F.lit(0).alias("p")).distinct().unionAll(predicted.select("s1_id", "cand_id", F.lit(0), F.lit(1)).distinct())
    pairs = marks.groupBy("s1_id", "cand_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    return _over(spine, counts)


def _over(spine: DataFrame, counts: DataFrame) -> DataFrame:
    return spine.join(counts, "s1_id", "left").select("s1_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_true", "n_pred", "tp")])


def _scores(n_true: Column, n_pred: Column, tp: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F0.5. Without a true match: recall 1, and the others 1 only if nothing was predicted."""
    none, empty = n_true == 0, (n_pred == 0).cast("double")
    p = F.when(none, empty).when(n_pred == 0, 0.0).otherwise(tp / n_pred)
    r = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp, n_true), F.lit(0.0)))
    f = F.when(none, empty).when(tp == 0, 0.0).otherwise(F.lit(1.25) * p * r / (F.lit(0.25) * p + r))
    return p, r, f


def entity_scores(spine: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return scored_counts(entity_counts(spine, truth, predicted))


def scored_counts(counts: DataFrame) -> DataFrame:
    p, r, f = _scores(F.col("n_true"), F.col("n_pred"), F.col("tp"))
    return counts.select("s1_id", (F.col("n_true") == 0).alias("is_singleton"), "n_true", "n_pred", p.alias("precision"), r.alias("recall"), f.alias("f0_5"))


def macro(scores: DataFrame) -> DataFrame:
    """Means over all entities and over those with and without a match."""
    part = F.when(F.col("is_singleton"), "singleton").otherwise("matched")
    rows = scores.select(F.explode(F.array(F.lit("all"), part)).alias("part"), "precision", "recall", "f0_5")
    return rows.groupBy("part").agg(F.count("*").alias("entities"), *[F.round(F.avg(c), DECIMALS).alias(f"macro_{c}") for c in ("precision", "recall", "f0_5")])


def bucketed(scores: DataFrame) -> DataFrame:
    """Each entity's kind of error."""
    n, p, r = F.col("n_pred"), F.col("precision"), F.col("recall")
    category = (
        F.when(F.col("is_singleton"), F.when(n == 0, "singleton_correct").otherwise("singleton_false_positive"))
        .when(n == 0, "nonsingleton_total_miss")
        .when((p == 1) & (r == 1), "nonsingleton_correct")
        .when(r == 1, "nonsingleton_over_matched")
        .when(p == 1, "nonsingleton_under_matched")
        .otherwise("nonsingleton_mixed_errors")
    )
    return scores.withColumn("category", category)


def error_report(buckets: DataFrame) -> DataFrame:
    """The worst entities first."""
    return buckets.orderBy("f0_5", "s1_id")


def bucket_summary(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("category").agg(F.count("*").alias("entities"), F.round(F.avg("f0_5"), DECIMALS).alias("mean_f0_5")).orderBy(F.desc("entities"), "category")


def bucket_by_country(buckets: DataFrame, countries: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Entities by category and country, zeros filled in. countries: (s1_id, country); values: those that get a column,
    else all that occur."""
    rows = buckets.join(countries, "s1_id", "left")
    return rows.groupBy("category").pivot("country", values).count().na.fill(0)


def sweep(spine: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Macro scores for every threshold (ascending), from one pass and without a row for each pair and threshold.

    Pairs are labelled first and counted by S1 entity and the number of thresholds that they reach. Over an entity's
    counts, summed from the highest number down, its scores change only where it has pairs; the changes, summed over all
    entities by that number and then from the top, and the scores without any prediction, give each threshold's sums.
    """
    key = ["s1_id", "cand_id"]
    steps = sorted(thresholds)
    true = truth.select(*key).distinct().select(*key, F.lit(1).alias("t"), F.lit(0).alias("at"), F.lit(0).alias("p"))
    pairs = scored.select(*key, F.lit(0), reached(steps), F.lit(1))
    marks = true.unionAll(pairs).groupBy(*key).agg(F.max("t").alias("t"), F.max("at").alias("at"), F.max("p").alias("p"))
    return _swept(spine, marks.groupBy("s1_id", "at").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.col("t") * F.col("p")).alias("tp")), steps)


def reached(steps: list[float]) -> Column:
    """How many of the ascending thresholds a score reaches."""
    return sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in steps), F.lit(0))


def true_counts(truth: DataFrame) -> DataFrame:
    """(s1_id, t): the number of true pairs of each S1 entity that has any."""
    return truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("*").alias("t"))


def tallied(pairs: DataFrame, thresholds: list[float], at: float) -> DataFrame:
    """pairs (s1_id, cand_id, score, label), each once, as counts (s1_id, at, predicted, p, tp): pairs and true ones by S1
    entity, number of thresholds reached and whether the score is at least `at`. All that is evaluated follows from them and
    true_counts, so that pairs don't move."""
    rows = pairs.select("s1_id", reached(sorted(thresholds)).alias("at"), (F.col("score") >= at).alias("predicted"), "label")
    return rows.groupBy("s1_id", "at", "predicted").agg(F.count("*").alias("p"), F.sum("label").alias("tp"))


def sweep_tallied(spine: DataFrame, true: DataFrame, tallies: DataFrame, thresholds: list[float]) -> DataFrame:
    """sweep, from true_counts and tallies."""
    rows = true.select("s1_id", F.lit(0).alias("at"), "t", F.lit(0).alias("p"), F.lit(0).alias("tp")).unionAll(tallies.select("s1_id", "at", F.lit(0), "p", "tp"))
    return _swept(spine, rows.groupBy("s1_id", "at").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")]), sorted(thresholds))


def counts_tallied(spine: DataFrame, true: DataFrame, tallies: DataFrame) -> DataFrame:
    """entity_counts, from true_counts and tallies."""
    rows = true.select("s1_id", "t", F.lit(0).alias("p"), F.lit(0).alias("tp")).unionAll(tallies.select("s1_id", F.lit(0), "p", "tp"))
    counts = rows.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum("tp").alias("tp"))
    return _over(spine, counts)


def report_tallied(spine: DataFrame, true: DataFrame, tallies: DataFrame, thresholds: list[float]) -> dict[str, DataFrame]:
    """report, from true_counts and tallies, which are read several times."""
    scores = scored_counts(counts_tallied(spine, true, tallies.where("predicted")))
    out = {"blocking_recall": recall_of(counts_tallied(spine, true, tallies)), "scores": scores, "macro": macro(scores), "buckets": bucket_summary(bucketed(scores)), "sweep": sweep_tallied(spine, true, tallies, thresholds)}
    return out | {"best": best(out["sweep"])}


def _swept(spine: DataFrame, counts: DataFrame, steps: list[float]) -> DataFrame:
    """counts (s1_id, at, t, p, tp): true pairs, pairs and true ones among them that reach so many of the thresholds."""
    down = Window.partitionBy("s1_id").orderBy(F.desc("at"))
    so_far = lambda c, to: F.coalesce(F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, to)), F.lit(0))
    n_true = F.sum("t").over(Window.partitionBy("s1_id"))
    counts = counts.select("s1_id", "at", n_true.alias("n_true"), *[so_far(c, to).alias(f"{c}{-to}") for c in ("p", "tp") for to in (0, -1)])
    known = counts.join(spine, "s1_id", "left_semi")
    after, before = (_scores(F.col("n_true"), F.col(f"p{k}"), F.col(f"tp{k}")) for k in (0, 1))
    names = ("p", "r", "f")
    changes = known.where("at > 0").groupBy("at").agg(*[F.sum(x - y).alias(n) for n, x, y in zip(names, after, before)])
    # Without a prediction: F0.5 and precision are 1 for entities without a true match and 0 for others, recall likewise.
    matched = known.where("n_true > 0").select("s1_id").distinct().agg(F.count("*").alias("m"))
    total = spine.agg(F.count("*").alias("n")).crossJoin(matched)
    rows = spine.sparkSession.createDataFrame(list(enumerate(steps, 1)), "at int, threshold double")
    from_above = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(changes), "at", "left").select("threshold", *[F.coalesce(F.sum(n).over(from_above), F.lit(0.0)).alias(n) for n in names])
    mean = lambda c: F.round((F.col("n") - F.col("m") + F.col(c)) / F.col("n"), DECIMALS)
    return rows.crossJoin(F.broadcast(total)).select("threshold", mean("f").alias("macro_f0_5"), mean("p").alias("macro_precision"), mean("r").alias("macro_recall"))


def thresholds(start: str, stop: str, step: str) -> list[float]:
    """start, start + step, ... up to and with stop; decimal strings, so that no step is lost to rounding."""
    from decimal import Decimal

    a, b, s = Decimal(start), Decimal(stop), Decimal(step)
    return [round(float(a + s * i), 4) for i in range(int((b - a) / s) + 1)]


def best(swept: DataFrame) -> DataFrame:
    """The threshold of the highest F0.5; the smallest of equals."""
    return swept.orderBy(F.desc("macro_f0_5"), "threshold").limit(1)


def blocking_recall(spine: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: coverage, pairs, pairs per S1 entity, recovered true pairs, recall."""
    return recall_of(entity_counts(spine, truth, edges))


def recall_of(c: DataFrame) -> DataFrame:
    total = c.agg(F.count("*").alias("total_s1"), F.sum((F.col("n_pred") > 0).cast("long")).alias("s1_with_candidates"), F.sum("n_pred").alias("candidate_pairs"), F.sum("n_true").alias("true_pairs"), F.sum("tp").alias("recovered"))
    return total.select("*", (F.col("s1_with_candidates") / F.col("total_s1")).alias("coverage"), (F.col("candidate_pairs") / F.col("total_s1")).alias("per_s1"), F.coalesce(F.try_divide("recovered", "true_pairs"), F.lit(0.0)).alias("recall"))


def compare_blockers(truth: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: true pairs that each blocker finds, that only the second finds, and that both find together."""
    key = ["s1_id", "cand_id"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(1))
    rows = truth.select(*key).distinct().join(mark(first, "f"), key, "left").join(mark(second, "s"), key, "left")
    hit = rows.agg(F.count("*").alias("true_pairs"), F.count("f").alias("first_hits"), F.count("s").alias("second_hits"), F.sum((F.col("f").isNull() & F.col("s").isNotNull()).cast("long")).alias("second_only"))
    both = F.col("first_hits") + F.col("second_only")
    return hit.select("*", both.alias("union_hits"), (both / F.col("true_pairs")).alias("union_recall"), (F.lit(100.0) * F.col("second_only") / F.col("true_pairs")).alias("gain_points"))


def report(spine: DataFrame, truth: DataFrame, candidates: DataFrame | None = None, predicted: DataFrame | None = None, scored: DataFrame | None = None, steps: list[float] | None = None) -> dict[str, DataFrame]:
    """All evaluations that the given tables allow, by name."""
    out = {}
    if candidates is not None:
        out["blocking_recall"] = blocking_recall(spine, truth, candidates)
    if predicted is not None:
        scores = entity_scores(spine, truth, predicted)
        out |= {"scores": scores, "macro": macro(scores), "buckets": bucket_summary(bucketed(scores))}
    if scored is not None:
        out["sweep"] = sweep(spine, truth, scored, steps or thresholds("0.10", "0.99", "0.01"))
        out["best"] = best(out["sweep"])
    return out


def candidate_quantiles(spine: DataFrame, edges: DataFrame, covered_only: bool, points: tuple = (0.5, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """Exact quantiles of candidates per S1 entity: one row for each point, and the maximum as point 1."""
    counts = edges.groupBy("s1_id").agg(F.count("*").alias("n"))
    rows = counts if covered_only else spine.join(counts, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    at = [*points, 1.0]
    found = rows.agg(F.percentile("n", at).alias("q"))
    return found.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in at]).alias("point"), F.col("q").alias("value"))).alias("x")).select(F.col("x.point").alias("point"), F.col("x.value").alias("value"))


def invariants(spine: DataFrame, candidates: DataFrame, matched: DataFrame, ref: DataFrame) -> DataFrame:
    """Violations of what a submission must hold; matched: the wide table."""
    from linkloom.functions.normalize import id_list

    parts = kept(matched.select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids")).alias("ids")))
    own = candidates.groupBy("s1_id").agg(F.collect_set("cand_id").alias("own"))
    lists = parts.join(own, "s1_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    once = F.size("ids") == F.size(F.array_distinct("ids"))
    among = F.when(once, F.size(F.array_intersect("ids", "own"))).otherwise(F.size(F.filter("ids", lambda x: F.array_contains("own", x))))
    named = parts.select(F.explode("ids").alias("cand_id")).groupBy("cand_id").agg(F.count("*").alias("n"))
    checks = {
        "row_per_s1": spine.join(parts.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").where(F.coalesce("n", F.lit(0)) != 1),
        "unknown_s1": parts.join(spine, "s1_id", "left_anti"),
        "repeated_ids": parts.where(~once),
        "unknown_ids": named.join(ref.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti"),
        "not_candidates": lists.select((F.size("ids") - among).cast("long").alias("n")),
    }
    many = {"unknown_ids", "not_candidates"}  # rows that stand for n violations
    out = None
    for name, rows in checks.items():
        row = rows.agg((F.coalesce(F.sum("n"), F.lit(0)) if name in many else F.count("*")).alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = row if out is None else out.unionAll(row)
    return out
