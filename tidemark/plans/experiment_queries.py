"""Checked queries: experiment statistics, posteriors and sequential tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cohort, draws, sequential
from tidemark.operators import experiments as ex
from tidemark.plans.views import view, with_views
from tidemark.plans.web_queries import sql_tidy, tidied

QUERIES = {}
CHECKS = {}
INTERVAL = 250
RATE = 0.1
Z_SUM = 1.959963984540054 + 1.6448536269514722


def checked(name, sql=None, views=("impressions",)):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = with_views(sql, *views)
        return query
    return register


def impressions(spark, folder):
    return view(spark, folder, "impressions")


def histogram(spark, folder):
    return ex.amount_histogram(impressions(spark, folder))


def paired_posterior(spark, folder, value, on_logs):
    stats = ex.sufficient_statistics(impressions(spark, folder), value)
    return ex.pair_variants(ex.normal_posterior(stats, on_logs=on_logs))


STATS = """
stats AS (SELECT experiment, variant, count({v}) AS n, sum({v}) AS total, avg({v}) AS mean,
  var_pop({v}) * count({v}) AS ssd, count({v}) FILTER ({v} > 0) AS positive,
  avg(CASE WHEN {v} > 0 THEN ln({v}) END) AS log_mean,
  var_pop(CASE WHEN {v} > 0 THEN ln({v}) END) * count({v}) FILTER ({v} > 0) AS log_ssd
  FROM impressions GROUP BY experiment, variant)
"""


@checked("sufficient_statistics", f"""
WITH {STATS.format(v='revenue')} SELECT experiment, variant, n, round(total, 4) AS total, round(mean, 6) AS mean,
round(ssd, 4) AS ssd, positive, round(log_mean, 6) AS log_mean, round(log_ssd, 4) AS log_ssd FROM stats""")
def sufficient_statistics(spark, folder):
    stats = ex.sufficient_statistics(impressions(spark, folder), "revenue")
    for column, digits in (("total", 4), ("mean", 6), ("ssd", 4), ("log_mean", 6), ("log_ssd", 4)):
        stats = stats.withColumn(column, F.round(column, digits))
    return stats


HISTOGRAM = """
histogram AS (SELECT experiment, variant, amount, count(*) AS n FROM impressions GROUP BY ALL)
"""
RATES = f"""
{HISTOGRAM},
totals AS (SELECT experiment, variant, sum(n) AS records, coalesce(sum(n) FILTER (amount = 0), 0) AS zeros
  FROM histogram GROUP BY ALL),
rates AS (SELECT h.experiment, h.variant, amount, 1 - CAST(zeros AS DOUBLE) / records AS p_donate,
  (CAST(n AS DOUBLE) / records) / (1 - CAST(zeros AS DOUBLE) / records) AS share
  FROM histogram h JOIN totals t ON h.experiment = t.experiment AND h.variant = t.variant WHERE amount > 0)
"""


@checked("amount_histogram", f"WITH {HISTOGRAM} SELECT * FROM histogram")
def amount_histogram(spark, folder):
    return histogram(spark, folder)


@checked("empirical_rates", f"""
WITH {RATES} SELECT experiment, variant, amount, {sql_tidy('p_donate')} AS p_donate,
{sql_tidy('share')} AS share FROM rates""")
def empirical_rates(spark, folder):
    return tidied(ex.empirical_rates(histogram(spark, folder)), "p_donate", "share")


@checked("lifted_distribution", f"""
WITH {RATES}, lifted AS (SELECT experiment, variant, amount, p_donate * 1.05 AS p, share FROM rates)
SELECT experiment, variant, amount, {sql_tidy('p * share')} AS probability FROM lifted
UNION ALL SELECT experiment, variant, 0, {sql_tidy('1 - max(p)')} FROM lifted GROUP BY experiment, variant""")
def lifted_distribution(spark, folder):
    rates = ex.apply_lift(ex.empirical_rates(histogram(spark, folder)), 0.05)
    return tidied(ex.outcome_distribution(rates), "probability")


@checked("replaced_rate_distribution", f"""
WITH {RATES} SELECT experiment, variant, amount, {sql_tidy('0.2 * share')} AS probability FROM rates
UNION ALL SELECT DISTINCT experiment, variant, 0, 0.8 FROM rates""")
def replaced_rate_distribution(spark, folder):
    rates = ex.with_rate(ex.empirical_rates(histogram(spark, folder)), 0.2)
    return tidied(ex.outcome_distribution(rates), "probability")


COUNTS = """
counts AS (SELECT experiment, variant, CAST(sum(converted) AS BIGINT) AS successes,
  CAST(sum(1 - converted) AS BIGINT) AS failures FROM impressions GROUP BY ALL)
"""


def posterior_counts(spark, folder):
    return ex.beta_posterior(ex.conversion_counts(impressions(spark, folder)))


@checked("beta_posterior", f"""
WITH {COUNTS} SELECT *, CAST(successes + 1 AS DOUBLE) AS alpha, CAST(failures + 1 AS DOUBLE) AS beta,
round((successes + 1.0) / (successes + failures + 2.0), 6) AS rate_mean FROM counts""")
def beta_posterior(spark, folder):
    return tidied(posterior_counts(spark, folder), "rate_mean")


NORMAL = """
posterior AS (SELECT experiment, variant, CAST({n} + 1 AS DOUBLE) AS k_n,
  4.0 / ({n} + 1) + {n} / ({n} + 1.0) * {mean} AS m_n, CAST({n} + 1 AS DOUBLE) AS v_n,
  1.0 + {ssd} + {n} * pow(4.0 - {mean}, 2) / ({n} + 1.0) AS v_n_s_sq_n FROM stats)
"""


@checked("normal_posterior", f"""
WITH {STATS.format(v='value')}, {NORMAL.format(n='n', mean='mean', ssd='ssd')}
SELECT experiment, variant, k_n, round(m_n, 6) AS m_n, v_n, round(v_n_s_sq_n, 4) AS v_n_s_sq_n FROM posterior""")
def normal_posterior(spark, folder):
    stats = ex.sufficient_statistics(impressions(spark, folder), "value")
    return ex.normal_posterior(stats).select(
        "experiment", "variant", F.col("k_n").cast("double").alias("k_n"), F.round("m_n", 6).alias("m_n"),
        F.col("v_n").cast("double").alias("v_n"), F.round("v_n_s_sq_n", 4).alias("v_n_s_sq_n"))


@checked("lognormal_posterior", f"""
WITH {STATS.format(v='revenue')}, {NORMAL.format(n='positive', mean='log_mean', ssd='log_ssd')}
SELECT experiment, variant, k_n, round(m_n, 6) AS m_n, v_n, round(v_n_s_sq_n, 4) AS v_n_s_sq_n FROM posterior""")
def lognormal_posterior(spark, folder):
    stats = ex.sufficient_statistics(impressions(spark, folder), "revenue")
    return ex.normal_posterior(stats, on_logs=True).select(
        "experiment", "variant", F.col("k_n").cast("double").alias("k_n"), F.round("m_n", 6).alias("m_n"),
        F.col("v_n").cast("double").alias("v_n"), F.round("v_n_s_sq_n", 4).alias("v_n_s_sq_n"))


# Two-sided p-value of Student's t by Simpson's rule on [0, |t|].
P_VALUE = """CASE WHEN t IS NULL OR dof IS NULL THEN NULL ELSE 1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2))
  / sqrt(dof * pi()) * abs(t) / 1200 * list_sum(list_transform(range(0, 401), lambda i:
  (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * pow(1 + pow(i * abs(t) / 400, 2) / dof, -(dof + 1) / 2))) END"""
WELCH = f"""
parts AS (SELECT *, a_ssd / a_n / a_n AS va, b_ssd / b_n / b_n AS vb FROM paired),
tested AS (SELECT *, (a_mean - b_mean) / sqrt(nullif(va + vb, 0)) AS t,
  pow(va + vb, 2) / nullif(va * va / (a_n - 1) + vb * vb / (b_n - 1), 0) AS dof FROM parts),
valued AS (SELECT *, {P_VALUE} AS p FROM tested)
"""


@checked("welch_t", f"""
WITH {STATS.format(v='amount')},
paired AS (SELECT experiment, max(n) FILTER (variant = 'A') AS a_n, max(n) FILTER (variant = 'B') AS b_n,
  max(mean) FILTER (variant = 'A') AS a_mean, max(mean) FILTER (variant = 'B') AS b_mean,
  max(ssd) FILTER (variant = 'A') AS a_ssd, max(ssd) FILTER (variant = 'B') AS b_ssd
  FROM stats GROUP BY experiment), {WELCH}
SELECT experiment, a_n, b_n, {sql_tidy('t')} AS t, round(dof, 4) AS dof, {sql_tidy('p')} AS p FROM valued""")
def welch_t(spark, folder):
    stats = ex.sufficient_statistics(impressions(spark, folder), "amount")
    tested = ex.welch_t(ex.pair_variants(stats))
    return tidied(tested, "t", "p").select("experiment", "a_n", "b_n", "t", F.round("dof", 4).alias("dof"), "p")


@checked("sample_size", f"""
WITH {HISTOGRAM}, moments AS (SELECT experiment, variant, sum(n) AS n, CAST(sum(amount * n) AS DOUBLE) AS s,
  CAST(sum(amount * amount * n) AS DOUBLE) AS ss FROM histogram GROUP BY ALL),
effects AS (SELECT experiment, variant, (s / n - s / n * 1.05) / sqrt(ss / n - (s / n) * (s / n)) AS d FROM moments)
SELECT experiment, variant, {sql_tidy('d')} AS effect_size,
round(2 * pow({Z_SUM} / d, 2), 2) AS sample_size FROM effects""")
def sample_size(spark, folder):
    sizes = ex.sample_size(histogram(spark, folder), 0.05)
    return tidied(sizes, "effect_size").withColumn("sample_size", F.round("sample_size", 2))


# Sampled logs: donations are all known, impressions are logged 1 in 10
# (two ids in twenty, since variants alternate by id).

SAMPLED = """
donations AS (SELECT * FROM impressions WHERE converted = 1),
logged AS (SELECT * FROM impressions WHERE impression_id % 20 < 2),
failed AS (SELECT * FROM logged WHERE impression_id NOT IN (SELECT impression_id FROM donations)),
sampled AS (SELECT d.experiment, d.variant, d.successes, f.observed_failures FROM
  (SELECT experiment, variant, count(*) AS successes FROM donations GROUP BY ALL) d JOIN
  (SELECT experiment, variant, count(*) AS observed_failures FROM failed GROUP BY ALL) f
  ON d.experiment = f.experiment AND d.variant = f.variant)
"""


def sampled(spark, folder):
    rows = impressions(spark, folder)
    return ex.sampled_counts(rows.where("impression_id % 20 < 2"), rows.where("converted = 1"))


@checked("unconverted_impressions", f"WITH {SAMPLED} SELECT impression_id, experiment, variant FROM failed")
def unconverted_impressions(spark, folder):
    rows = impressions(spark, folder)
    return ex.unconverted_impressions(rows.where("impression_id % 20 < 2"), rows.where("converted = 1")).select(
        "impression_id", "experiment", "variant")


@checked("sampled_counts", f"WITH {SAMPLED} SELECT * FROM sampled")
def sampled_counts(spark, folder):
    return sampled(spark, folder)


@checked("population_estimates", f"""
WITH {SAMPLED} SELECT *, round((observed_failures + 1) / 0.1::DOUBLE - 1, 6) AS expected,
round(observed_failures / 0.1::DOUBLE, 6) AS lower_bound,
round((observed_failures + 1) / 0.1::DOUBLE, 6) AS upper_bound FROM sampled""")
def population_estimates(spark, folder):
    return tidied(ex.population_estimates(sampled(spark, folder), RATE), "expected", "lower_bound", "upper_bound")


@checked("naive_sampled_posterior", f"""
WITH {SAMPLED}, estimated AS (SELECT *, CAST(floor((observed_failures + 1) / 0.1::DOUBLE - 1) AS BIGINT) AS failures
  FROM sampled)
SELECT *, CAST(successes + 1 AS DOUBLE) AS alpha, CAST(failures + 1 AS DOUBLE) AS beta,
round((successes + 1.0) / (successes + failures + 2.0), 6) AS rate_mean FROM estimated""")
def naive_sampled_posterior(spark, folder):
    return tidied(ex.naive_posterior(sampled(spark, folder), RATE), "rate_mean")


@checked("inverse_binomial_pmf", f"""
WITH {SAMPLED}, spread AS (SELECT experiment, variant, observed_failures AS n,
  unnest(range(observed_failures, 20 * observed_failures + 201)) AS population FROM sampled)
SELECT *, round(exp(lgamma(population + 1.0) - lgamma(n + 1.0) - lgamma(population - n + 1.0)
  + (n + 1) * ln(0.1) + (population - n) * ln(0.9)), 8) AS probability FROM spread""")
def inverse_binomial_pmf(spark, folder):
    counts = sampled(spark, folder).select("experiment", "variant", F.col("observed_failures").alias("n"))
    pmf = ex.inverse_binomial_pmf(counts, RATE, F.col("n") * 20 + 200)
    return pmf.withColumn("probability", F.round("probability", 8))


@checked("inverse_binomial_mass", f"""
WITH {SAMPLED}, spread AS (SELECT experiment, variant, observed_failures AS n,
  unnest(range(observed_failures, 12 * observed_failures + 1)) AS population FROM sampled),
masses AS (SELECT experiment, variant, n, sum(exp(lgamma(population + 1.0) - lgamma(n + 1.0)
  - lgamma(population - n + 1.0) + (n + 1) * ln(0.1) + (population - n) * ln(0.9))) AS mass
  FROM spread GROUP BY ALL)
SELECT experiment, variant, n, round(mass, 6) AS mass, round(1 - mass, 6) AS tail, 1.0::DOUBLE AS whole FROM masses""")
def inverse_binomial_mass(spark, folder):
    """The mass up to twelve times the records, and the closed tail beyond it."""
    counts = sampled(spark, folder).select("experiment", "variant", F.col("observed_failures").alias("n"))
    upper = F.col("n") * 12
    masses = ex.inverse_binomial_pmf(counts, RATE, upper).groupBy("experiment", "variant", "n").agg(
        F.sum("probability").alias("mass"))
    both = ex.inverse_binomial_tail(masses, RATE, upper)
    return both.withColumn("whole", F.round(F.col("mass") + F.col("tail"), 9)).withColumn(
        "mass", F.round("mass", 6)).withColumn("tail", F.round("tail", 6))


@checked("interval_coverage", f"""
WITH {SAMPLED} SELECT experiment, variant, CASE WHEN 1000 BETWEEN observed_failures / 0.1::DOUBLE
AND (observed_failures + 1) / 0.1::DOUBLE THEN 1 ELSE 0 END AS covered FROM sampled""")
def interval_coverage(spark, folder):
    bounds = ex.population_estimates(sampled(spark, folder), RATE)
    return bounds.select("experiment", "variant",
                         ex.interval_covers("lower_bound", "upper_bound", 1000.0).alias("covered"))


# Checkpoints and decisions.

CHECKPOINTS = f"""
numbered AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY experiment, variant ORDER BY ts, impression_id)
  / {INTERVAL}.0) AS BIGINT) AS checkpoint FROM impressions),
steps AS (SELECT experiment, variant, checkpoint, count(*) AS c, count(*) FILTER (amount > 0) AS h,
  sum(amount) AS s, sum(amount * amount) AS ss FROM numbered GROUP BY ALL HAVING count(*) = {INTERVAL}),
sums AS (SELECT experiment, variant, checkpoint, CAST(sum(c) OVER w AS BIGINT) AS n,
  CAST(sum(h) OVER w AS BIGINT) AS successes, CAST(sum(s) OVER w AS DOUBLE) AS total,
  CAST(sum(ss) OVER w AS DOUBLE) AS squares FROM steps
  WINDOW w AS (PARTITION BY experiment, variant ORDER BY checkpoint)),
checkpoints AS (SELECT *, n - successes AS failures, total / n AS mean, squares - total * (total / n) AS ssd FROM sums)
"""
PAIRED = """
paired AS (SELECT experiment, checkpoint, max(n) FILTER (variant = 'A') AS a_n,
  max(n) FILTER (variant = 'B') AS b_n, max(mean) FILTER (variant = 'A') AS a_mean,
  max(mean) FILTER (variant = 'B') AS b_mean, max(ssd) FILTER (variant = 'A') AS a_ssd,
  max(ssd) FILTER (variant = 'B') AS b_ssd FROM checkpoints GROUP BY ALL HAVING count(*) = 2)
"""
DECIDED = f"""
{CHECKPOINTS}, {PAIRED}, {WELCH},
results AS (SELECT *, CASE WHEN p < 0.05 AND a_mean > b_mean THEN 'A' WHEN p < 0.05 THEN 'B'
  WHEN greatest(a_n, b_n) > 1000 THEN 'unknown' ELSE 'continue' END AS result FROM valued
  QUALIFY checkpoint <= coalesce(min(checkpoint) FILTER (greatest(a_n, b_n) > 1000) OVER (
    PARTITION BY experiment), checkpoint))
"""


@checked("checkpoint_counts", f"""
WITH {CHECKPOINTS} SELECT experiment, variant, checkpoint, n, successes, failures, total, round(mean, 6) AS mean,
round(ssd, 4) AS ssd FROM checkpoints""")
def checkpoint_counts(spark, folder):
    counts = sequential.checkpoint_counts(impressions(spark, folder), INTERVAL)
    return counts.withColumn("mean", F.round("mean", 6)).withColumn("ssd", F.round("ssd", 4))


@checked("checkpoint_histograms", f"""
WITH {CHECKPOINTS}, listed AS (SELECT DISTINCT experiment, amount FROM impressions),
full_steps AS (SELECT experiment, variant, checkpoint FROM steps)
SELECT f.experiment, f.variant, f.checkpoint, l.amount, (SELECT count(*) FROM numbered x
  WHERE x.experiment = f.experiment AND x.variant = f.variant AND x.checkpoint <= f.checkpoint
  AND x.amount = l.amount) AS n
FROM full_steps f JOIN listed l ON l.experiment = f.experiment""")
def checkpoint_histograms(spark, folder):
    return sequential.checkpoint_histograms(impressions(spark, folder), INTERVAL)


@checked("ttest_results", f"""
WITH {DECIDED} SELECT experiment, checkpoint, {sql_tidy('t')} AS t, {sql_tidy('p')} AS p, result FROM results""")
def ttest_results(spark, folder):
    results = sequential.ttest_results(impressions(spark, folder), INTERVAL, 0.05, 1000)
    return tidied(results, "t", "p").select("experiment", "checkpoint", "t", "p", "result")


@checked("ttest_decisions", f"""
WITH {DECIDED} SELECT experiment, checkpoint, result, greatest(a_n, b_n) AS records FROM results
WHERE result <> 'continue' QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY checkpoint) = 1""")
def ttest_decisions(spark, folder):
    return sequential.first_decision(
        sequential.ttest_results(impressions(spark, folder), INTERVAL, 0.05, 1000))


@checked("rate_streaks", f"""
WITH {CHECKPOINTS}, hits AS (SELECT experiment, checkpoint,
  max(mean) FILTER (variant = 'A') > max(mean) FILTER (variant = 'B') AS hit
  FROM checkpoints GROUP BY ALL HAVING count(*) = 2),
islands AS (SELECT *, coalesce(max(CASE WHEN hit THEN 0 ELSE checkpoint END) OVER (
  PARTITION BY experiment ORDER BY checkpoint), 0) AS miss FROM hits)
SELECT experiment, checkpoint, hit, checkpoint - miss AS streak FROM islands""")
def rate_streaks(spark, folder):
    counts = sequential.checkpoint_counts(impressions(spark, folder), INTERVAL)
    hits = ex.pair_variants(counts, ["experiment", "checkpoint"]).select(
        "experiment", "checkpoint", (F.col("a_mean") > F.col("b_mean")).alias("hit"))
    return sequential.streak_lengths(hits, "hit", "streak")


@checked("dirichlet_mean", f"""
WITH {HISTOGRAM}, listed AS (SELECT DISTINCT experiment, amount FROM histogram),
grid AS (SELECT v.experiment, v.variant, l.amount FROM (SELECT DISTINCT experiment, variant FROM histogram) v
  JOIN listed l ON l.experiment = v.experiment),
dense AS (SELECT g.*, coalesce(h.n, 0) AS n FROM grid g LEFT JOIN histogram h
  ON h.experiment = g.experiment AND h.variant = g.variant AND h.amount = g.amount)
SELECT experiment, variant, round(CAST(sum((n + 1) * amount) AS DOUBLE) / sum(n + 1), 6) AS mean_amount,
CAST(sum(n) AS BIGINT) AS n FROM dense GROUP BY ALL""")
def dirichlet_mean(spark, folder):
    dense = ex.with_all_amounts(histogram(spark, folder))
    return tidied(draws.dirichlet_mean(dense, ex.KEYS), "mean_amount")


@checked("zero_inflated_fit", f"""
WITH {STATS.format(v='revenue')},
grid AS (SELECT experiment, variant, n, positive AS k, log_mean AS m, log_ssd AS ssd, 0.1 + i * (1.4 / 1999) AS sigma
  FROM stats, range(0, 2000) r(i)),
terms AS (SELECT *, k / (sigma * sigma) + 0.01 AS prec FROM grid),
weighed AS (SELECT *, (k * m / (sigma * sigma) + 0.001) / prec AS center,
  -k * ln(sigma) - ssd / (2 * sigma * sigma) - 0.5 * ln(prec)
  - 0.5 * k * 0.01 / (k + 0.01 * sigma * sigma) * pow(m - 0.1, 2) AS lw FROM terms),
scaled AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY experiment, variant)) AS w FROM weighed),
fitted AS (SELECT experiment, variant, (max(n) - max(k) + 1.0) / (max(n) + 2.0) AS p, max(n) AS n,
  sum(w * center) / sum(w) AS mu, sum(w * (1 / prec + center * center)) / sum(w) AS mu2,
  sum(w * sigma) / sum(w) AS sigma, sum(w * sigma * sigma) / sum(w) AS sigma2 FROM scaled GROUP BY ALL)
SELECT experiment, variant, round(p, 6) AS p_zero, round(sqrt(p * (1 - p) / (n + 3)), 6) AS p_zero_sd,
  round(mu, 5) AS mu, round(sqrt(mu2 - mu * mu), 5) AS mu_sd, round(sigma, 5) AS sigma,
  round(sqrt(sigma2 - sigma * sigma), 5) AS sigma_sd FROM fitted""")
def zero_inflated_fit(spark, folder):
    stats = ex.sufficient_statistics(impressions(spark, folder), "revenue")
    fit = draws.zero_inflated_lognormal(stats, list(ex.KEYS)).select(
        *ex.KEYS, "p_zero", "p_zero_sd", "mu", "mu_sd", "sigma", "sigma_sd")
    for column in ("p_zero", "p_zero_sd"):
        fit = fit.withColumn(column, F.round(column, 6))
    for column in ("mu", "mu_sd", "sigma", "sigma_sd"):
        fit = fit.withColumn(column, F.round(column, 5))
    return fit


# Draws: random by nature, seeded, checked by rows here and by statistics in the tests.

@checked("normal_comparison")
def normal_comparison(spark, folder):
    return draws.compare_normal(paired_posterior(spark, folder, "value", False)).select(
        "experiment", "p_mean_a_greater", "p_variance_a_greater")


@checked("normal_draws")
def normal_draws(spark, folder):
    stats = ex.normal_posterior(ex.sufficient_statistics(impressions(spark, folder), "value"))
    return draws.posterior_draws(stats, list(ex.KEYS))


@checked("drawn_posterior_summary")
def drawn_posterior_summary(spark, folder):
    return cohort.sample_summary(normal_draws(spark, folder), list(ex.KEYS), "mu")


@checked("lognormal_comparison")
def lognormal_comparison(spark, folder):
    return draws.compare(paired_posterior(spark, folder, "revenue", True), draws.lognormal_mean_draws)


@checked("hurdle_comparison")
def hurdle_comparison(spark, folder):
    return draws.compare(paired_posterior(spark, folder, "revenue", True), draws.hurdle_mean_draws)


@checked("rate_intervals")
def rate_intervals(spark, folder):
    return draws.rate_interval(ex.conversion_counts(impressions(spark, folder)), list(ex.KEYS))


@checked("beta_lift")
def beta_lift(spark, folder):
    return draws.compare(ex.pair_variants(posterior_counts(spark, folder)), draws.rate_draws, draws=20_000)


@checked("naive_sampled_lift")
def naive_sampled_lift(spark, folder):
    naive = ex.naive_posterior(sampled(spark, folder), RATE)
    return draws.compare(ex.pair_variants(naive), draws.rate_draws, draws=20_000)


@checked("proper_sampled_lift")
def proper_sampled_lift(spark, folder):
    lifts = draws.compare(ex.pair_variants(sampled(spark, folder)), draws.sampled_rate_draws(RATE), draws=20_000)
    return lifts.withColumn("covers_no_lift", ex.interval_covers("lift_lower", "lift_upper", 0.0))


@checked("amount_comparison")
def amount_comparison(spark, folder):
    return draws.compare_amounts(ex.with_all_amounts(histogram(spark, folder)))


@checked("credibility_decisions")
def credibility_decisions(spark, folder):
    return sequential.amount_decisions(
        impressions(spark, folder), INTERVAL, lambda df: draws.stop_credibility(df, 0.95, 1000), max_run=1000)


@checked("expected_cost_decisions")
def expected_cost_decisions(spark, folder):
    return sequential.amount_decisions(
        impressions(spark, folder), INTERVAL, lambda df: draws.stop_expected_cost(df, 0.0002, 1000), max_run=1000)


@checked("streak_decisions")
def streak_decisions(spark, folder):
    return sequential.streak_decisions(impressions(spark, folder), INTERVAL, 0.9, 2, 1000)


@checked("baseline_checkpoints")
def baseline_checkpoints(spark, folder):
    return sequential.baseline_checkpoint(impressions(spark, folder), INTERVAL, 0.1)
