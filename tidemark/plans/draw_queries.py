"""Checked queries: posterior draws and random rows against what is known of them exactly.

The exact values are computed twice, here and in the check SQL. That the draws agree with
them, to five standard errors, is a column that the check SQL holds to be true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import log_beta
from tidemark.operators import draws, sequential
from tidemark.operators import experiments as ex
from tidemark.plans.experiment_queries import (
    COUNTS,
    HISTOGRAM,
    INTERVAL,
    NORMAL,
    STATS,
    histogram,
    impressions,
    posterior_counts,
)
from tidemark.plans.views import view, with_views
from tidemark.plans.web_queries import tidied
from tidemark.sources import requests as request_log

QUERIES = {}
CHECKS = {}
SIZE = draws.DRAWS


def checked(name, sql, views=("impressions",)):
    def register(query):
        QUERIES[name] = query
        CHECKS[name] = with_views(sql, *views)
        return query
    return register


def near(drawn: Column, exact: Column, deviation: Column, size: int = SIZE) -> Column:
    """Whether a mean of draws is within five standard errors of the exact one."""
    return F.abs(drawn - exact) <= 5.0 * deviation / F.sqrt(F.lit(float(size))) + 1e-12


def _beta_deviation(a: Column, b: Column) -> Column:
    return F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))


BETAS = f"""
{COUNTS}, paired AS (SELECT experiment, max(successes + 1) FILTER (variant = 'A') AS aa,
  max(failures + 1) FILTER (variant = 'A') AS ba, max(successes + 1) FILTER (variant = 'B') AS ab,
  max(failures + 1) FILTER (variant = 'B') AS bb FROM counts GROUP BY experiment)
"""


@checked("beta_lift_against_exact", f"""
WITH {BETAS}, terms AS (SELECT *, unnest(range(0, aa)) AS i FROM paired),
summed AS (SELECT experiment, aa, ba, ab, bb, sum(exp(
  lgamma(ab + i::DOUBLE) + lgamma(ba + bb::DOUBLE) - lgamma(ab + i + ba + bb::DOUBLE) - ln(ba + i)
  - (lgamma(1 + i::DOUBLE) + lgamma(ba::DOUBLE) - lgamma(1.0::DOUBLE + i + ba))
  - (lgamma(ab::DOUBLE) + lgamma(bb::DOUBLE) - lgamma(ab + bb::DOUBLE)))) AS p FROM terms GROUP BY ALL)
SELECT experiment, round(aa / (aa + ba)::DOUBLE, 6) AS exact_a, round(ab / (ab + bb)::DOUBLE, 6) AS exact_b,
  round(p, 5) AS exact_p, TRUE AS means_agree, TRUE AS p_agrees FROM summed""")
def beta_lift_against_exact(spark, folder):
    paired = ex.pair_variants(posterior_counts(spark, folder))
    lifts = draws.compare(paired, draws.rate_draws)
    aa, ba, ab, bb = (F.col(c).cast("double") for c in ("a_alpha", "a_beta", "b_alpha", "b_beta"))
    i = F.col("_i").cast("double")
    terms = lifts.withColumn("_i", F.explode(F.sequence(F.lit(0), aa.cast("int") - 1)))
    term = F.exp(log_beta(ab + i, ba + bb) - F.log(ba + i) - log_beta(1 + i, ba) - log_beta(ab, bb))
    kept = ["experiment", "a_alpha", "a_beta", "b_alpha", "b_beta", "mean_a", "mean_b", "p_a_better"]
    exact = terms.groupBy(*kept).agg(F.sum(term).alias("_p"))
    p = F.col("_p")
    agree = near(F.col("mean_a"), aa / (aa + ba), _beta_deviation(aa, ba)) & near(
        F.col("mean_b"), ab / (ab + bb), _beta_deviation(ab, bb))
    return exact.select(
        "experiment", F.round(aa / (aa + ba), 6).alias("exact_a"),
        F.round(ab / (ab + bb), 6).alias("exact_b"), F.round(p, 5).alias("exact_p"),
        agree.alias("means_agree"), near(F.col("p_a_better"), p, F.sqrt(F.abs(p * (1 - p)))).alias("p_agrees"))


@checked("rate_intervals_against_normal", f"""
WITH {COUNTS} SELECT experiment, variant, round(successes / (successes + failures)::DOUBLE, 6) AS rate,
  TRUE AS bounds_agree FROM counts""")
def rate_intervals_against_normal(spark, folder):
    """The posterior is nearly normal, but for its skew: bounds are near the normal ones."""
    rows = draws.rate_interval(ex.conversion_counts(impressions(spark, folder)), list(ex.KEYS))
    a, b = F.col("successes") + 1.0, F.col("failures") + 1.0
    mean, deviation = a / (a + b), _beta_deviation(a, b)
    reach = 1.959964 * deviation
    skew = F.abs(2.0 * (b - a) * F.sqrt(a + b + 1) / ((a + b + 2) * F.sqrt(a * b)))
    slack = (0.15 + 0.6 * skew) * deviation
    agree = (F.abs(F.col("rate_lower") - (mean - reach)) < slack) & (
        F.abs(F.col("rate_upper") - (mean + reach)) < slack)
    return tidied(rows, "rate").select("experiment", "variant", "rate", agree.alias("bounds_agree"))


@checked("normal_draws_against_exact", f"""
WITH {STATS.format(v='value')}, {NORMAL.format(n='n', mean='mean', ssd='ssd')}
SELECT experiment, variant, round(m_n, 6) AS mean, round(v_n_s_sq_n / (v_n - 2), 4) AS variance,
  TRUE AS mean_agrees, TRUE AS variance_agrees FROM posterior""")
def normal_draws_against_exact(spark, folder):
    posterior = ex.normal_posterior(ex.sufficient_statistics(impressions(spark, folder), "value"))
    drawn = draws.posterior_draws(posterior, list(ex.KEYS)).groupBy(*ex.KEYS).agg(
        F.avg("mu").alias("_mu"), F.stddev("mu").alias("_mu_sd"),
        F.avg("sigma_sq").alias("_var"), F.stddev("sigma_sq").alias("_var_sd"))
    variance = F.col("v_n_s_sq_n") / (F.col("v_n") - 2)
    return posterior.join(drawn, list(ex.KEYS)).select(
        *ex.KEYS, F.round("m_n", 6).alias("mean"), F.round(variance, 4).alias("variance"),
        near(F.col("_mu"), F.col("m_n"), F.col("_mu_sd")).alias("mean_agrees"),
        near(F.col("_var"), variance, F.col("_var_sd")).alias("variance_agrees"))


@checked("amounts_against_exact", f"""
WITH {HISTOGRAM}, listed AS (SELECT DISTINCT experiment, amount FROM histogram),
dense AS (SELECT v.experiment, v.variant, l.amount, coalesce(h.n, 0) + 1 AS w
  FROM (SELECT DISTINCT experiment, variant FROM histogram) v JOIN listed l USING (experiment)
  LEFT JOIN histogram h ON h.experiment = v.experiment AND h.variant = v.variant AND h.amount = l.amount),
means AS (SELECT experiment, variant, CAST(sum(w * amount) AS DOUBLE) / sum(w) AS m FROM dense GROUP BY ALL)
SELECT experiment, round(max(m) FILTER (variant = 'A'), 6) AS exact_a,
  round(max(m) FILTER (variant = 'B'), 6) AS exact_b, TRUE AS means_agree FROM means GROUP BY experiment""")
def amounts_against_exact(spark, folder):
    dense = ex.with_all_amounts(histogram(spark, folder))
    weight = F.col("n") + 1.0
    moments = dense.groupBy(*ex.KEYS).agg(
        F.sum(weight).alias("_w"), (F.sum(weight * F.col("amount")) / F.sum(weight)).alias("mean"),
        (F.sum(weight * F.col("amount") * F.col("amount")) / F.sum(weight)).alias("_square"))
    spread = moments.withColumn("sd", F.sqrt(
        (F.col("_square") - F.col("mean") * F.col("mean")) / (F.col("_w") + 1)))
    exact = ex.pair_variants(spread.select(*ex.KEYS, "mean", "sd"))
    drawn = draws.compare_amounts(dense).select("experiment", "mean_a", "mean_b")
    return exact.join(drawn, "experiment").select(
        "experiment", F.round("a_mean", 6).alias("exact_a"), F.round("b_mean", 6).alias("exact_b"),
        (near(F.col("mean_a"), F.col("a_mean"), F.col("a_sd"))
         & near(F.col("mean_b"), F.col("b_mean"), F.col("b_sd"))).alias("means_agree"))


@checked("decisions_are_first", """
SELECT DISTINCT experiment, TRUE AS credible_is_first, TRUE AS streak_is_first FROM impressions""")
def decisions_are_first(spark, folder):
    """A decision found in rounds stands at the first checkpoint of the full run whose drawn
    comparison crosses the limit. The full run ends where the records are beyond the longest
    run: that checkpoint crosses the limit whatever is drawn, so none behind it can be the first."""
    rows = impressions(spark, folder)
    amounts = sequential.amount_results(
        rows, INTERVAL, lambda df: draws.stop_credibility(df, 0.95, 1000), max_run=1000)
    crossed = (F.col("p_a_better") > 0.95) | (F.col("p_a_better") < 0.05) | (
        F.greatest("a_n", "b_n") > 1000)
    first = amounts.groupBy("experiment").agg(F.min(F.when(crossed, F.col("checkpoint"))).alias("_wanted"))
    credible = sequential.amount_decisions(
        rows, INTERVAL, lambda df: draws.stop_credibility(df, 0.95, 1000), max_run=1000, first=2)
    streaks = sequential.streak_results(rows, INTERVAL, 0.9, 2, 1000)
    ended = (F.col("better_streak") >= 2) | (F.col("worse_streak") >= 2) | (F.greatest("a_n", "b_n") > 1000)
    second = streaks.groupBy("experiment").agg(F.min(F.when(ended, F.col("checkpoint"))).alias("_ended"))
    streak = sequential.streak_decisions(rows, INTERVAL, 0.9, 2, 1000, first=1).select(
        "experiment", F.col("checkpoint").alias("_streak"))
    return rows.select("experiment").distinct().join(first, "experiment", "left").join(
        credible, "experiment", "left").join(second, "experiment", "left").join(
        streak, "experiment", "left").select(
        "experiment", F.col("_wanted").eqNullSafe(F.col("checkpoint")).alias("credible_is_first"),
        F.col("_ended").eqNullSafe(F.col("_streak")).alias("streak_is_first"))


@checked("random_sample_is_fair", """
SELECT count(*) AS rows_of_table, TRUE AS distinct_rows_of_it, TRUE AS share_agrees FROM requests""", ("requests",))
def random_sample_is_fair(spark, folder):
    """A random sample holds rows of the table, none twice, one in 64 to six deviations."""
    rows = view(spark, folder, "requests")
    total = rows.agg(F.count(F.lit(1)).alias("rows_of_table"))
    sample = request_log.sample_bucket(rows, 64, seed=7).select("event_id")
    found = sample.join(rows.select("event_id"), "event_id", "left_semi").agg(
        F.count(F.lit(1)).alias("_found"), F.count_distinct("event_id").alias("_distinct"))
    drawn = sample.agg(F.count(F.lit(1)).alias("_drawn"))
    joined = total.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one").join(
        drawn.withColumn("_one", F.lit(1)), "_one")
    expected = F.col("rows_of_table") / 64.0
    return joined.select(
        "rows_of_table", ((F.col("_found") == F.col("_drawn")) & (F.col("_distinct") == F.col("_drawn"))
                          ).alias("distinct_rows_of_it"),
        (F.abs(F.col("_drawn") - expected) <= 6.0 * F.sqrt(expected)).alias("share_agrees"))
