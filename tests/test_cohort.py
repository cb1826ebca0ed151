"""Survival data, reports and models."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort, models

ACTIVITY = ("user_id LONG, month DATE, cla_0 LONG, cla_1 LONG, cla_2 LONG, cla_3 LONG, cla_tot LONG, "
            "cala_0 LONG, crla_0 LONG, v_no_months INT, aeb_no_months INT, talk_counts LONG, friend_count LONG")


def activity(spark):
    def row(user, month, *edits):
        return (user, date(2009, month, 28), *edits, sum(edits) + 2, 1, 0, month, month - 1, 3, 4)
    return spark.createDataFrame([
        row(1, 3, 1, 2, 3, 4), row(1, 4, 5, 0, 0, 1), row(1, 5, 1, 0, 0, 0),
        row(2, 4, 2, 2, 2, 2), row(2, 6, 1, 1, 1, 1), row(3, 3, 9, 9, 9, 9), row(3, 5, 1, 1, 1, 1)], ACTIVITY)


def test_survival_row(spark):
    df = cohort.survival_dataset(activity(spark), date(2009, 4, 28), date(2009, 5, 1), date(2009, 5, 31))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = {r.user_id: r for r in df.collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].survive, rows[2].survive) == (1, 0)
    first = rows[1]
    assert (first.num_edits_0, first.num_edits_rest, first.num_edits_total) == (5, 2, 8)
    assert (first.num_edits_to_date_0, first.num_edits_to_date_tot) == (6, 20)
    assert (first.num_edits_got_archived_to_date_0, first.months_since_registration) == (2, 4)
    assert len(cohort.FEATURES) == 17 and df.columns == ["user_id", *cohort.FEATURES, "survive"]


def test_profiles_and_mix(spark):
    profile = cohort.career_profile(activity(spark), more_than=2, extended=True).collect()
    assert [r.user_id for r in profile] == [1]
    assert profile[0].avg_monthly_edits_0 == pytest.approx(7 / 3)
    assert profile[0].var_monthly_edits_0 == pytest.approx(math.sqrt(sum((x - 7 / 3) ** 2 for x in (1, 5, 1)) / 3))
    assert profile[0].percent_edits_got_archived_0 == pytest.approx(3 / 7)
    mix = {r.user_id: r.percent_main for r in cohort.activity_mix(activity(spark), date(2009, 4, 28)).collect()}
    assert mix == {1: 5 / 8, 2: 2 / 10}
    empty = activity(spark).withColumn("cla_tot", F.lit(0).cast("long"))
    assert {r.percent_main for r in cohort.activity_mix(empty, date(2009, 4, 28)).collect()} == {0.0}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 10, 50)], "v DOUBLE")
    found = {r.bin: r.n for r in cohort.histogram(df, "v", 5, below=50).collect()}
    assert found == {0: 2, 1: 2, 2: 1, 4: 1}
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE")
    assert [(r.bin, r.n) for r in cohort.histogram(constant, "v").collect()] == [(0, 2)]


def test_folds_are_stratified(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    counts = {(r.label, r.fold): r["count"] for r in
              cohort.stratified_folds(df, "label", "id", 4, seed=3).groupBy("label", "fold").count().collect()}
    assert {counts[0, f] for f in range(4)} == {225}
    assert {counts[1, f] for f in range(4)} == {25}


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1), (0, 0.7)]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0
               for a, p in rows if a for b, n in rows if not b)
    found = cohort.roc_auc(spark.createDataFrame(rows, "y INT, s DOUBLE"), "y", "s").first()
    assert found.roc_auc == pytest.approx(wins / 12)
    one_class = cohort.roc_auc(spark.createDataFrame([(1, 0.5)], "y INT, s DOUBLE"), "y", "s").first()
    assert one_class.roc_auc is None


def test_report(spark):
    rows = [(0, 1, 1)] * 3 + [(0, 1, 0)] + [(0, 0, 1)] * 2 + [(1, 0, 0)] * 4 + [(1, 1, 0)]
    report = cohort.confusion_report(spark.createDataFrame(rows, "fold INT, label INT, prediction INT"))
    found = {(r.fold, r["class"]): (r.precision, r.recall, r.f_score, r.support) for r in report.collect()}
    assert found[0, 1] == (3 / 5, 3 / 4, pytest.approx(2 / 3), 4)
    assert found[0, 0] == (0.0, 0.0, 0.0, 2)
    assert found[1, 1] == (0.0, 0.0, 0.0, 1)
    summary = {(r["class"], r.measure): (r.mean, r.deviation) for r in cohort.report_summary(report).collect()}
    assert summary[1, "precision"] == pytest.approx((0.3, 0.3))
    assert summary[None, "support"] == pytest.approx((2.75, math.sqrt(sum((x - 2.75) ** 2 for x in (4, 2, 4, 1)) / 4)))


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, float(i % 17), float(i * 7 % 23), int(i % 17 + i * 7 % 23 > 19)) for i in range(400)]
    df = spark.createDataFrame(rows, "id LONG, a DOUBLE, b DOUBLE, survive INT")
    folded = cohort.stratified_folds(df, "survive", "id", 2)
    return models.prepared(folded, ["a", "b"], keep=("id", "fold")).coalesce(1).checkpoint()


def test_grid_search_and_holdout(spark, learnable):
    model, grid = models.logistic_grid(200, (0.1, 100))
    search = models.grid_search(learnable, ["a", "b"], model, grid, scaled=True)
    scores = models.grid_scores(learnable, search).collect()
    assert len(scores) == 2 and any(r.best for r in scores)
    assert max(r.mean_auc for r in scores) > 0.95
    report = models.holdout_report(search.bestModel, learnable).first()
    assert report.roc_auc > 0.95 and report.f1 > 0.8


def test_saved_forest_scores_alike(spark, learnable, tmp_path):
    model, grid = models.forest_grid((5,))
    search = models.grid_search(learnable, ["a", "b"], model, grid)
    importances = {r.feature: r.importance for r in models.feature_importances(
        learnable, search.bestModel, ["a", "b"]).collect()}
    assert set(importances) == {"a", "b"} and max(importances.values()) == 100.0
    path = str(tmp_path / "model")
    models.save_model(search.bestModel, path)
    again = models.load_model(path)
    assert again.stages[0].getInputCols() == ["a", "b"]
    before = models.scored(search.bestModel, learnable).select("id", "score")
    assert before.exceptAll(models.scored(again, learnable).select("id", "score")).count() == 0


def test_components_are_centered(spark, learnable):
    projected, variance = models.principal_components(learnable, ["a", "b"])
    means = projected.agg(F.avg("pc1"), F.avg("pc2"), F.corr("pc1", "pc2")).first()
    assert all(abs(m) < 1e-6 for m in means)
    assert sum(variance) == pytest.approx(1.0)


def test_percentiles_of_repeated_values(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 1, 9, 2)] + [("b", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    found = {r.k: r for r in cohort.sample_summary(df, ["k"], "v", (0, 30, 50, 100)).collect()}
    values = [v for k, v in rows if k == "a"]
    for p in (0, 30, 50, 100):
        assert found["a"][f"p{p}"] == pytest.approx(np.percentile(values, p))
        assert found["b"][f"p{p}"] == 7.0 and found["c"][f"p{p}"] is None


def test_random_rows_are_the_first_by_place(spark):
    df = spark.range(3000).withColumn("v", F.col("id") * 2)
    places = sorted((r.p, r.id) for r in df.select("id", F.xxhash64("id", F.lit(5)).alias("p")).collect())
    for n in (0, 1, 100, 2999, 3000, 5000):
        found = cohort.random_rows(df, n, 5, "id").collect()
        assert sorted(r.id for r in found) == sorted(i for _, i in places[:n])
        assert all(r.v == 2 * r.id for r in found)
        assert cohort.random_rows(df, n, 5).select("id").distinct().count() == min(n, 3000)
    assert cohort.random_rows(df.limit(0), 4, 5, "id").count() == 0
    same = spark.range(500).withColumn("k", F.lit(1))
    assert cohort.random_rows(same, 7, 5, "k").count() == 7


def test_converged_fit_meets_its_conditions(learnable):
    model, settings = models.logistic_grid(200, (1,))
    loose, tight = (models.fitted(learnable, ["a", "b"], model.copy(
        {**settings[0], model.tol: tol, model.maxIter: steps}), True) for tol, steps in ((0.1, 1), (1e-10, 500)))
    scaled = models.standardized(learnable, ["a", "b"])
    wanted = scaled.agg(F.avg("label"), F.avg(F.col("label") * F.col("a")), F.avg(F.col("label") * F.col("b"))).first()

    def worst(fit):
        rows = models.logistic_conditions(learnable, ["a", "b"], fit).collect()
        assert [r.feature for r in rows] == ["", "a", "b"]
        return max(abs(r.moment - w) for r, w in zip(rows, wanted, strict=True))

    assert worst(tight) < 1e-6 < worst(loose)


def test_one_setting_is_fitted_once(spark, monkeypatch):
    """A grid of one setting gives the model that a search over it ends with, without its folds."""
    rows = [(i % 2, float((i * 7) % 5 > 1 or i % 3 == 0), float(i * 7 % 5), float(i * i % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "fold INT, label DOUBLE, a DOUBLE, b DOUBLE").coalesce(1)
    model, grid = models.forest_grid((4,))
    searched = models.grid_search(df, ["a", "b"], model, grid).bestModel
    monkeypatch.setattr(models, "grid_search", None)
    best = models.best_model(df, ["a", "b"], model, grid)
    assert best.stages[-1].toDebugString == searched.stages[-1].toDebugString.replace(
        searched.stages[-1].uid, best.stages[-1].uid)
    assert best.stages[-1].getNumTrees == 4


def test_a_linear_grid_has_no_tasks_of_a_few_rows(spark, learnable):
    context = spark.sparkContext
    spread = learnable.repartition(9).cache()
    rows = spread.count()
    context.setJobGroup("linear grid", "")
    try:
        model, grid = models.svm_grid(rows // 2, (0.1, 1))
        search = models.grid_search(spread, ["a", "b"], model.setMaxIter(5), grid)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spread.unpersist()
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("linear grid")]
    stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    tasks = [s.numTasks for s in stages if s and "RDDLossFunction" in s.name]
    assert tasks and max(tasks) == 1
    assert len(search.avgMetrics) == 2 and min(search.avgMetrics) > 0.9
    assert models.in_few_parts(spread, -(-rows // 3)).rdd.getNumPartitions() == 3  # no more than asked for
