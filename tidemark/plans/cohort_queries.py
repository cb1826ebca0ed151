"""Checked queries: survival data, descriptive tables and models."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions.numbers import tidy
from tidemark.operators import cohort, models
from tidemark.plans.views import table, view, with_views
from tidemark.plans.web_queries import sql_tidy, tidied
from tidemark.session import scratch_path, written

QUERIES = {}
CHECKS = {}
HORIZON = date(1998, 6, 30)
PREDICTION = date(1998, 7, 31)


def checked(name, sql=None, views=("activity",)):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = with_views(sql, *views)
        return query
    return register


TO_DATE = """
to_date AS (SELECT user_id, CAST(sum(cla_0) AS BIGINT) AS num_edits_to_date_0,
  CAST(sum(cla_1) AS BIGINT) AS num_edits_to_date_1, CAST(sum(cla_2) AS BIGINT) AS num_edits_to_date_2,
  CAST(sum(cla_3) AS BIGINT) AS num_edits_to_date_3, CAST(sum(cla_tot) AS BIGINT) AS num_edits_to_date_tot,
  CAST(sum(cala_0) AS BIGINT) AS num_edits_got_archived_to_date_0,
  CAST(sum(crla_0) AS BIGINT) AS num_edits_got_reverted_to_date_0
  FROM activity WHERE month <= DATE '1998-06-30' GROUP BY user_id)
"""
SURVIVAL = f"""
{TO_DATE},
survival AS (SELECT x.user_id, CAST(cla_0 AS INT) AS num_edits_0, CAST(cla_1 AS INT) AS num_edits_1,
  CAST(cla_2 AS INT) AS num_edits_2, CAST(cla_3 AS INT) AS num_edits_3,
  CAST(cla_tot AS INT) AS num_edits_total,
  CAST(cla_tot - cla_0 - cla_1 - cla_2 - cla_3 AS INT) AS num_edits_rest,
  CAST(v_no_months AS INT) AS months_since_registration,
  CAST(aeb_no_months AS INT) AS months_since_5_edits,
  CAST(talk_counts AS INT) AS talk_counts, CAST(friend_count AS INT) AS friend_count,
  z.* EXCLUDE (user_id), CASE WHEN y.user_id IS NOT NULL THEN 1 ELSE 0 END AS survive
  FROM activity x LEFT JOIN (SELECT DISTINCT user_id FROM activity
    WHERE month BETWEEN DATE '1998-07-31' AND DATE '1998-07-31') y ON x.user_id = y.user_id
  LEFT JOIN to_date z ON x.user_id = z.user_id WHERE x.month = DATE '1998-06-30')
"""


def survival(spark, folder):
    return cohort.survival_dataset(view(spark, folder, "activity"), HORIZON, PREDICTION, PREDICTION)


@checked("to_date_totals", f"WITH {TO_DATE} SELECT * FROM to_date")
def to_date_totals(spark, folder):
    return cohort.to_date_totals(view(spark, folder, "activity"), HORIZON)


@checked("survival_dataset", f"WITH {SURVIVAL} SELECT * FROM survival")
def survival_dataset(spark, folder):
    return survival(spark, folder)


@checked("survival_counts", f"WITH {SURVIVAL} SELECT survive, count(*) AS n FROM survival GROUP BY survive")
def survival_counts(spark, folder):
    return cohort.value_counts(survival(spark, folder), "survive")


@checked("random_survival_rows")
def random_survival_rows(spark, folder):
    return cohort.random_rows(survival(spark, folder), 100, 7, "user_id")


@checked("career_profile", f"""
WITH profile AS (SELECT user_id, avg(cla_0) AS a0, stddev_pop(cla_0) AS s0, avg(cla_1) AS a1,
  stddev_pop(cla_1) AS s1 FROM activity GROUP BY user_id HAVING count(*) > 5)
SELECT user_id, {sql_tidy('a0')} AS avg_monthly_edits_0, {sql_tidy('s0')} AS var_monthly_edits_0,
  {sql_tidy('a1')} AS avg_monthly_edits_1, {sql_tidy('s1')} AS var_monthly_edits_1 FROM profile""")
def career_profile(spark, folder):
    return tidied(cohort.career_profile(view(spark, folder, "activity")),
                  "avg_monthly_edits_0", "var_monthly_edits_0", "avg_monthly_edits_1",
                  "var_monthly_edits_1")


def _extended():
    parts = []
    for name, source in (("edits_0", "cla_0"), ("edits_1", "cla_1"), ("edits_2", "cla_2"),
                         ("edits_3", "cla_3"), ("edits_tot", "cla_tot")):
        parts.append(f"{sql_tidy(f'avg({source})')} AS avg_monthly_{name}")
        parts.append(f"{sql_tidy(f'stddev_pop({source})')} AS var_monthly_{name}")
    return ", ".join(parts)


@checked("career_profile_extended", f"""
SELECT user_id, {_extended()}, {sql_tidy('avg(friend_count)')} AS avg_friend_count,
  {sql_tidy('stddev_pop(friend_count)')} AS var_friend_count, count(*) AS num_active_months,
  coalesce({sql_tidy('CAST(sum(cala_0) AS DOUBLE) / nullif(sum(cla_0), 0)')}, 0) AS percent_edits_got_archived_0,
  coalesce({sql_tidy('CAST(sum(crla_0) AS DOUBLE) / nullif(sum(cla_0), 0)')}, 0) AS percent_edits_got_reverted_0
FROM activity GROUP BY user_id HAVING count(*) > 5""")
def career_profile_extended(spark, folder):
    profile = cohort.career_profile(view(spark, folder, "activity"), extended=True)
    return tidied(profile, *[c for c in profile.columns if c not in ("user_id", "num_active_months")])


@checked("activity_mix", """
SELECT user_id, round(CAST(cla_0 AS DOUBLE) / cla_tot, 6) AS percent_main,
  round(CAST(cla_1 AS DOUBLE) / cla_tot, 6) AS percent_talk,
  round(CAST(cla_2 AS DOUBLE) / cla_tot, 6) AS percent_user,
  round(CAST(cla_3 AS DOUBLE) / cla_tot, 6) AS percent_usertalk
FROM activity WHERE month = DATE '1998-05-31'""")
def activity_mix(spark, folder):
    return tidied(cohort.activity_mix(view(spark, folder, "activity"), date(1998, 5, 31)),
                  "percent_main", "percent_talk", "percent_user", "percent_usertalk")


CORRELATED = ["cla_0", "cla_1", "cla_2", "cla_3", "cla_tot", "cala_0", "crla_0", "talk_counts",
              "friend_count"]


@checked("activity_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, {sql_tidy(f'corr({a}, {b})')} AS r FROM activity"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i:]))
def activity_correlations(spark, folder):
    return tidied(cohort.correlations(view(spark, folder, "activity"), CORRELATED), "r")


@checked("spending_histogram", """
WITH spent AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders
  WHERE o_totalprice > 40000 AND o_totalprice < 300000),
edge AS (SELECT min(x) AS lo, max(x) AS hi FROM spent),
binned AS (SELECT least(CAST(floor((x - lo) * 20 / (hi - lo)) AS BIGINT), 19) AS bin, lo, hi
  FROM spent, edge)
SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS from_value,
  round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS to_value, count(*) AS n FROM binned GROUP BY bin, lo, hi""",
         ())
def spending_histogram(spark, folder):
    return tidied(cohort.histogram(table(spark, folder, "orders"), "o_totalprice", 20, 40000, 300000),
                  "from_value", "to_value")


@checked("stratified_folds", """
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 2 AS INT) AS fold
FROM labels""", ())
def stratified_folds(spark, folder):
    return cohort.stratified_folds(table(spark, folder, "labels").select("doc_id", "quality"),
                                   "quality", "doc_id", 2, hashed=False)


SCORES = """
scores AS (SELECT quality, toxic, CAST(n_chars % 97 AS DOUBLE) AS score, CAST(d.doc_id % 3 AS INT) AS fold
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def label_scores(spark, folder):
    joined = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("quality", "toxic", (F.col("n_chars") % 97).cast("double").alias("score"),
                         (F.col("doc_id") % 3).cast("int").alias("fold"))


@checked("roc_auc", f"""
WITH {SCORES},
ranked AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
  FROM scores),
sums AS (SELECT CAST(sum(quality) AS BIGINT) AS positives, CAST(count(*) - sum(quality) AS BIGINT) AS negatives,
  sum(r) FILTER (quality = 1) AS rank_sum FROM ranked)
SELECT positives, negatives, round((rank_sum - positives * (positives + 1) / 2.0)
  / (CAST(positives AS DOUBLE) * negatives), 6) AS roc_auc FROM sums""", ())
def roc_auc(spark, folder):
    return tidied(cohort.roc_auc(label_scores(spark, folder), "quality", "score"), "roc_auc")


@checked("roc_auc_by_fold", f"""
WITH {SCORES},
ranked AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY score)
  + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM scores),
sums AS (SELECT fold, CAST(sum(quality) AS BIGINT) AS positives, CAST(count(*) - sum(quality) AS BIGINT) AS negatives,
  sum(r) FILTER (quality = 1) AS rank_sum FROM ranked GROUP BY fold),
areas AS (SELECT fold, positives, negatives, (rank_sum - positives * (positives + 1) / 2.0)
  / (CAST(positives AS DOUBLE) * negatives) AS area FROM sums)
SELECT fold, positives, negatives, round(area, 6) AS roc_auc, round(avg(area) OVER (), 6) AS mean_auc,
  round(stddev_pop(area) OVER (), 6) AS auc_deviation FROM areas""", ())
def roc_auc_by_fold(spark, folder):
    rows = label_scores(spark, folder).withColumn("label", F.col("quality"))
    return tidied(models.roc_by_fold(rows), "roc_auc", "mean_auc", "auc_deviation")


@checked("nearest_clusters", """
SELECT count(*) AS users, TRUE AS all_in_the_nearest FROM (
  SELECT user_id FROM activity GROUP BY user_id HAVING count(*) > 5) u""")
def nearest_clusters(spark, folder):
    """Every user is in the cluster whose mean is nearest, to a small slack for the last step."""
    profile = cohort.career_profile(view(spark, folder, "activity"))
    columns = [c for c in profile.columns if c != "user_id"]
    found = written(models.k_means(profile, columns, 4).select("user_id", "cluster", *columns), "clusters")
    centers = found.groupBy("cluster").agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    gathered = centers.agg(F.collect_list(F.struct("cluster", *[f"_{c}" for c in columns])).alias("_centers"))
    placed = found.withColumn("_one", F.lit(1)).join(gathered.withColumn("_one", F.lit(1)), "_one")

    def distance(center):
        return F.sqrt(sum(F.pow(F.col(c) - center[f"_{c}"], F.lit(2)) for c in columns))

    nearest = F.array_min(F.transform("_centers", distance))
    own = F.aggregate(F.filter("_centers", lambda m: m["cluster"] == F.col("cluster")), F.lit(0.0),
                      lambda total, m: total + distance(m))
    return placed.agg(F.count(F.lit(1)).alias("users"),
                      F.bool_and(own <= nearest * 1.25 + 0.1).alias("all_in_the_nearest"))


REPORT = f"""
{SCORES}, said AS (SELECT fold, quality AS actual, CASE WHEN score > 30 THEN 1 ELSE 0 END AS said FROM scores),
report AS (SELECT fold, c AS class,
  coalesce(CAST(count(*) FILTER (actual = c AND said = c) AS DOUBLE) / nullif(count(*) FILTER (said = c), 0), 0) AS precision,
  coalesce(CAST(count(*) FILTER (actual = c AND said = c) AS DOUBLE) / nullif(count(*) FILTER (actual = c), 0), 0) AS recall,
  coalesce(2.0 * CAST(count(*) FILTER (actual = c AND said = c) AS DOUBLE)
    / nullif(count(*) FILTER (said = c) + count(*) FILTER (actual = c), 0), 0) AS f_score,
  count(*) FILTER (actual = c) AS support
  FROM said, (VALUES (0), (1)) v(c) GROUP BY fold, c)
"""


def label_report(spark, folder):
    said = label_scores(spark, folder).select(
        "fold", F.col("quality").alias("label"), F.when(F.col("score") > 30, 1).otherwise(0).alias("prediction"))
    return cohort.confusion_report(said)


@checked("confusion_report", f"""
WITH {REPORT} SELECT fold, class, {sql_tidy('precision')} AS precision, {sql_tidy('recall')} AS recall,
{sql_tidy('f_score')} AS f_score, support FROM report""", ())
def confusion_report(spark, folder):
    return tidied(label_report(spark, folder), "precision", "recall", "f_score")


@checked("report_summary", f"""
WITH {REPORT},
long AS (SELECT class, 'precision' AS measure, precision AS value FROM report
  UNION ALL SELECT class, 'recall', recall FROM report UNION ALL SELECT class, 'f_score', f_score FROM report
  UNION ALL SELECT class, 'support', CAST(support AS DOUBLE) FROM report)
SELECT class, measure, {sql_tidy('avg(value)')} AS mean, {sql_tidy('stddev_pop(value)')} AS deviation
FROM long GROUP BY GROUPING SETS ((class, measure), (measure))""", ())
def report_summary(spark, folder):
    return tidied(cohort.report_summary(label_report(spark, folder)), "mean", "deviation")


@checked("order_value_summary", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS deviation,
  round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.5), 4) AS p50,
  round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY o_orderpriority""", ())
def order_value_summary(spark, folder):
    summary = cohort.sample_summary(table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice")
    for column in ("mean", "deviation", "p5", "p50", "p95"):
        summary = summary.withColumn(column, tidy(column, 4))
    return summary


@checked("activity_density", """
WITH shares AS (SELECT CAST(cla_0 AS DOUBLE) / cla_tot AS x, CAST(cla_1 AS DOUBLE) / cla_tot AS y FROM activity)
SELECT CASE WHEN x < 0 THEN 0 WHEN x >= 1 THEN 11 ELSE CAST(floor(x * 10) AS BIGINT) + 1 END AS x_bin,
  CASE WHEN y < 0 THEN 0 WHEN y >= 1 THEN 11 ELSE CAST(floor(y * 10) AS BIGINT) + 1 END AS y_bin,
  count(*) AS n FROM shares GROUP BY ALL""")
def activity_density(spark, folder):
    shares = view(spark, folder, "activity").select(
        (F.col("cla_0") / F.col("cla_tot")).alias("x"), (F.col("cla_1") / F.col("cla_tot")).alias("y"))
    return cohort.density_table(shares, "x", "y", 10)


# Models: SQL cannot fit one, so those of the grids are checked by rows only. The queries after
# them hold fits against conditions that SQL can state.

def folded(spark, folder):
    """Survival data with folds, as numbers; written once since every fit reads it."""
    rows = cohort.survival_dataset(view(spark, folder, "activity"), HORIZON, date(1998, 7, 31),
                                   date(1998, 12, 31))
    folds = cohort.stratified_folds(rows, "survive", "user_id", 2)
    return written(models.prepared(folds, cohort.FEATURES, keep=("fold", "user_id")), "folds")


def refolded(train):
    """Inner folds, stratified as the outer ones are."""
    return cohort.stratified_folds(train.drop("fold"), "label", "user_id", 2, seed=1)


def _searched(spark, folder, grid, scaled=False):
    data = folded(spark, folder)
    model, settings = grid(data) if callable(grid) else grid
    return data, models.grid_search(data, cohort.FEATURES, model, settings, 2, scaled)


SCALED = ["cla_0", "cla_1", "cla_tot", "v_no_months"]


@checked("standardized_activity", "SELECT user_id, month, " + ", ".join(
    f"{sql_tidy(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}" for c in SCALED)
    + " FROM activity")
def standardized_activity(spark, folder):
    rows = view(spark, folder, "activity").select("user_id", "month", *SCALED)
    return tidied(models.standardized(rows, SCALED), *SCALED)


@checked("svm_grid_scores")
def svm_grid_scores(spark, folder):
    return models.grid_scores(*_searched(spark, folder, lambda d: models.svm_grid(d.count() // 2)))


@checked("logistic_grid_scores")
def logistic_grid_scores(spark, folder):
    return models.grid_scores(*_searched(
        spark, folder, lambda d: models.logistic_grid(d.count() // 2), scaled=True))


@checked("forest_holdout_report")
def forest_holdout_report(spark, folder):
    data = folded(spark, folder)
    model, settings = models.forest_grid()
    train = refolded(data.where("fold = 0"))
    best = models.best_model(train, cohort.FEATURES, model, settings)
    return models.holdout_report(best, data.where("fold = 1"))


@checked("boosting_importances")
def boosting_importances(spark, folder):
    # All depths, with 20 trees in place of the default grid's 150 and 250.
    data, search = _searched(spark, folder, models.boosting_grid((20,)))
    return models.feature_importances(data, search.bestModel, cohort.FEATURES)


@checked("saved_model_scores")
def saved_model_scores(spark, folder):
    data = folded(spark, folder)
    path = scratch_path(spark, "model")
    models.save_model(models.best_model(data, cohort.FEATURES, *models.forest_grid()), path)
    return models.scored(models.load_model(path), data).select("fold", "label", "prediction", "score")


@checked("nested_fold_predictions")
def nested_fold_predictions(spark, folder):
    data = folded(spark, folder)
    model, settings = models.logistic_grid(data.count() // 4)

    return cohort.report_summary(cohort.confusion_report(models.nested_report(
        data, cohort.FEATURES, model, settings, 2, True, refolded)))


@checked("career_components")
def career_components(spark, folder):
    profile = cohort.career_profile(view(spark, folder, "activity"))
    columns = [c for c in profile.columns if c != "user_id"]
    projected, variance = models.principal_components(profile, columns)
    return projected.select("user_id", "pc1", "pc2", F.lit(variance[0]).alias("explained_1"),
                            F.lit(variance[1]).alias("explained_2"))


@checked("career_clusters")
def career_clusters(spark, folder):
    profile = cohort.career_profile(view(spark, folder, "activity"))
    columns = [c for c in profile.columns if c != "user_id"]
    return models.k_means(profile, columns, 4).select("user_id", "cluster")


SURVIVED = f"WITH {SURVIVAL}"


def survivors(spark, folder):
    """Survival data as numbers, written once since fit and report both read it."""
    return written(models.prepared(survival(spark, folder), cohort.FEATURES, keep=("user_id",)), "survivors")


@checked("logistic_moments", f"""
{SURVIVED} SELECT '' AS feature, round(avg(survive), 4) AS moment FROM survival
UNION ALL """ + " UNION ALL ".join(f"""
SELECT '{c}', coalesce(round((avg(survive * coalesce({c}, 0)) - avg(survive) * avg(coalesce({c}, 0)))
  / nullif(stddev_samp(coalesce({c}, 0)), 0), 4), 0) FROM survival""" for c in cohort.FEATURES))
def logistic_moments(spark, folder):
    """A converged fit gives back the label's moments with the scaled features."""
    data = survivors(spark, folder)
    model, settings = models.logistic_grid(data.count(), (1,))
    fit = models.fitted(data, cohort.FEATURES, model.copy(
        {**settings[0], model.tol: 1e-10, model.maxIter: 1000}), scaled=True)
    return models.logistic_conditions(data, cohort.FEATURES, fit).withColumn("moment", tidy("moment", 4))


@checked("profile_components", f"""
WITH profile AS (SELECT user_id, avg(cla_0) AS x, stddev_pop(cla_0) AS y FROM activity
  GROUP BY user_id HAVING count(*) > 5),
moments AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b
  FROM profile),
roots AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS large,
  (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS small FROM moments),
turned AS (SELECT user_id, large, small,
  abs(b * (x - mx) + (large - a) * (y - my)) / sqrt(b * b + (large - a) ** 2) AS p1,
  abs(b * (x - mx) + (small - a) * (y - my)) / sqrt(b * b + (small - a) ** 2) AS p2 FROM profile, roots)
SELECT user_id, round(p1, 4) AS distance_1, round(p2, 4) AS distance_2,
  {sql_tidy('large / (large + small)')} AS explained_1, {sql_tidy('small / (large + small)')} AS explained_2
FROM turned""")
def profile_components(spark, folder):
    """Distances along the components; two features have them in closed form."""
    columns = ["avg_monthly_edits_0", "var_monthly_edits_0"]
    profile = cohort.career_profile(view(spark, folder, "activity")).select("user_id", *columns)
    projected, variance = models.principal_components(written(profile, "profile"), columns)
    return tidied(projected.select(
        "user_id", tidy(F.abs("pc1"), 4).alias("distance_1"), tidy(F.abs("pc2"), 4).alias("distance_2"),
        F.lit(variance[0]).alias("explained_1"), F.lit(variance[1]).alias("explained_2")),
        "explained_1", "explained_2")


@checked("saved_model_agrees", f"""
{SURVIVED} SELECT CAST(survive AS DOUBLE) AS label, count(*) AS n, TRUE AS scores_agree
FROM survival GROUP BY survive""")
def saved_model_agrees(spark, folder):
    """A model read back scores every row as the fitted one does."""
    data = survivors(spark, folder)
    fit = models.fitted(data, cohort.FEATURES, models.forest_grid((10,))[0])
    path = scratch_path(spark, "model")
    models.save_model(fit, path)
    first, again = (models.scored(m, data).select("user_id", "label", F.col("score").alias(name))
                    for m, name in ((fit, "_first"), (models.load_model(path), "_again")))
    return first.join(again, ["user_id", "label"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("_first") == F.col("_again")).alias("scores_agree"))


@checked("nested_predictions_cover", f"""
{SURVIVED}, sizes AS (SELECT CAST(survive AS DOUBLE) AS label, count(*) AS n FROM survival GROUP BY survive)
SELECT CAST(fold AS INT) AS fold, label, (n + 1 - fold) // 2 AS rows, (n + 1 - fold) // 2 AS scored,
  TRUE AS report_agrees FROM sizes, range(2) AS folds(fold)""")
def nested_predictions_cover(spark, folder):
    """Every row is predicted once, in its fold, and the report's support counts the same rows."""
    data = written(cohort.stratified_folds(survivors(spark, folder), "label", "user_id", 2), "folds")
    model, settings = models.logistic_grid(data.count() // 4, (1,))
    said = written(models.nested_report(data, cohort.FEATURES, model, settings, 2, True, refolded), "said")
    counted = said.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("score").isNotNull(), 1)).alias("scored"))
    support = cohort.confusion_report(said).select(
        "fold", F.col("class").cast("double").alias("label"), "support")
    return counted.join(support, ["fold", "label"], "left").select(
        "fold", "label", "rows", "scored", F.col("support").eqNullSafe(F.col("rows")).alias("report_agrees"))
