"""Experiment statistics that are exact: counts, rates, posterior parameters, tests.

Everything starts from sums per (experiment, variant), taken in one grouped pass
with map-side partial sums, so the records of a large variant never meet in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import beta_share, log_choose, ratio, t_p_value

KEYS = ("experiment", "variant")


def sufficient_statistics(df: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, mean and squared deviations of a value, and of the log of its positive part.

    ``n`` counts all rows and ``positive`` those above zero; ``total`` is the sum.
    """
    x = F.col(value).cast("double")
    log_x = F.when(x > 0, F.log(x))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("ssd"),
        F.count(log_x).alias("positive"), F.avg(log_x).alias("log_mean"),
        (F.var_pop(log_x) * F.count(log_x)).alias("log_ssd"))


def amount_histogram(df: DataFrame, keys: Sequence[str] = KEYS, amount: str = "amount") -> DataFrame:
    """Records per amount, zero included."""
    return df.groupBy(*keys, F.col(amount).alias("amount")).agg(F.count(F.lit(1)).alias("n"))


def with_all_amounts(histogram: DataFrame, experiment: str = "experiment",
                     variant: str = "variant") -> DataFrame:
    """Adds zero counts for the amounts a variant lacks but its experiment has."""
    amounts = histogram.select(experiment, "amount").distinct()
    variants = histogram.select(experiment, variant).distinct()
    grid = variants.join(amounts, experiment).select(
        experiment, variant, "amount", F.lit(0).cast("long").alias("n"))
    return histogram.select(experiment, variant, "amount", "n").unionByName(grid).groupBy(
        experiment, variant, "amount").agg(F.sum("n").alias("n"))


def empirical_rates(histogram: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Donation rate, and each positive amount's share of the donations."""
    zeros = F.sum(F.when(F.col("amount") == 0, F.col("n")).otherwise(0))
    totals = histogram.groupBy(*keys).agg(
        F.sum("n").alias("_total"), (1.0 - ratio(zeros, F.sum("n"))).alias("p_donate"))
    share = F.try_divide(ratio(F.col("n"), F.col("_total")), F.col("p_donate"))
    return histogram.where(F.col("amount") > 0).join(totals, list(keys)).select(
        *keys, "amount", "p_donate", share.alias("share"))


def apply_lift(rates: DataFrame, lift: float) -> DataFrame:
    """Raises the donation rate by a relative lift; the amounts keep their shares."""
    return rates.withColumn("p_donate", F.col("p_donate") * (1.0 + lift))


def with_rate(rates: DataFrame, p_donate: float | Column) -> DataFrame:
    """Replaces the donation rate; the amounts keep their shares."""
    return rates.withColumn("p_donate", p_donate if isinstance(p_donate, Column) else F.lit(p_donate))


def outcome_distribution(rates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Probability of every amount, zero included."""
    positive = rates.select(*keys, "amount", (F.col("p_donate") * F.col("share")).alias("probability"))
    zero = rates.groupBy(*keys).agg((1.0 - F.max("p_donate")).alias("probability")).select(
        *keys, F.lit(0).cast(rates.schema["amount"].dataType).alias("amount"), "probability")
    return positive.unionByName(zero)


def conversion_counts(df: DataFrame, keys: Sequence[str] = KEYS, converted: str = "converted") -> DataFrame:
    """Successes and failures per variant."""
    hit = F.col(converted).cast("long")
    return df.groupBy(*keys).agg(F.sum(hit).alias("successes"), F.sum(1 - hit).alias("failures"))


def beta_posterior(counts: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Parameters and mean of the posterior of a rate."""
    a, b = F.col("successes") + F.lit(alpha), F.col("failures") + F.lit(beta)
    return counts.withColumn("alpha", a).withColumn("beta", b).withColumn("rate_mean", a / (a + b))


def normal_posterior(stats: DataFrame, m0: float = 4.0, k0: float = 1.0, s_sq0: float = 1.0,
                     v0: float = 1.0, on_logs: bool = False) -> DataFrame:
    """Parameters of the normal-inverse-gamma posterior of mean and variance.

    ``k0`` weighs the prior mean ``m0``, ``v0`` weighs the prior variance ``s_sq0``,
    both in rows. With ``on_logs`` it is about the logs of the positive values.
    """
    n = F.col("positive" if on_logs else "n")
    mean = F.coalesce(F.col("log_mean" if on_logs else "mean"), F.lit(0.0))
    ssd = F.coalesce(F.col("log_ssd" if on_logs else "ssd"), F.lit(0.0))
    k_n = n + F.lit(k0)
    scale = F.lit(v0 * s_sq0) + ssd + n * F.lit(k0) * F.pow(F.lit(m0) - mean, 2) / k_n
    return (stats.withColumn("k_n", k_n)
            .withColumn("m_n", F.lit(k0 * m0) / k_n + n / k_n * mean)
            .withColumn("v_n", n + F.lit(v0))
            .withColumn("v_n_s_sq_n", scale))


def pair_variants(stats: DataFrame, keys: Sequence[str] = ("experiment",), variant: str = "variant",
                  a: str = "A", b: str = "B") -> DataFrame:
    """One row per key with the columns of both variants, named a_... and b_...

    Keys without both variants are left out.
    """
    columns = [c for c in stats.columns if c not in (*keys, variant)]
    picked = [F.max(F.when(F.col(variant) == name, F.col(c))).alias(f"{side}_{c}")
              for side, name in (("a", a), ("b", b)) for c in columns]
    seen = [F.max((F.col(variant) == name).cast("int")).alias(f"_{side}")
            for side, name in (("a", a), ("b", b))]
    both = stats.groupBy(*keys).agg(*picked, *seen)
    return both.where((F.col("_a") == 1) & (F.col("_b") == 1)).drop("_a", "_b")


def welch_t(paired: DataFrame) -> DataFrame:
    """Welch's t, its degrees of freedom and two-sided p-value.

    Needs a_n, a_mean, a_ssd and the same for b. Variances are divided by n. No
    variance at all gives NULLs.
    """
    def part(side):
        n = F.col(f"{side}_n").cast("double")
        return n, F.try_divide(F.try_divide(F.col(f"{side}_ssd"), n), n)

    (n_a, a), (n_b, b) = part("a"), part("b")
    t = F.try_divide(F.col("a_mean") - F.col("b_mean"), F.sqrt(a + b))
    dof = F.try_divide(F.pow(a + b, 2), F.try_divide(a * a, n_a - 1) + F.try_divide(b * b, n_b - 1))
    tested = paired.withColumn("t", t).withColumn("dof", dof)
    return tested.withColumn("p", t_p_value("t", "dof"))


def stop_result(decided_a: Column, decided_b: Column, max_run: float | None) -> Column:
    """'A' or 'B' if decided, 'unknown' past the longest run, else 'continue'."""
    result = F.when(decided_a, "A").when(decided_b, "B")
    if max_run is not None:
        result = result.when(F.greatest("a_n", "b_n") > F.lit(max_run), "unknown")
    return result.otherwise("continue")


def stop_ttest(tested: DataFrame, alpha: float = 0.05, max_run: float | None = None) -> DataFrame:
    """Decides for the larger mean once p is below alpha; an undefined p goes on."""
    sure = F.coalesce(F.col("p") < alpha, F.lit(False))
    larger = F.col("a_mean") > F.col("b_mean")
    return tested.withColumn("result", stop_result(sure & larger, sure & ~larger, max_run))


def sample_size(histogram: DataFrame, mde: float, alpha: float = 0.05, power: float = 0.95,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Records per variant that show a relative change of ``mde`` in the mean amount.

    Two-sample test in its normal form, 2 ((z1 + z2) / d)^2 with the standardized
    effect d.
    """
    means = histogram.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.try_divide(F.sum(F.col("amount") * F.col("n")).cast("double"), F.sum("n")).alias("_mean"))
    # Squares of deviations from the mean, so that large amounts do not cancel.
    away = F.col("amount") - F.col("_mean")
    moments = histogram.join(means, list(keys)).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_mean").alias("_mean"),
        F.sum(away * away * F.col("n")).alias("_squares"))
    mean = F.col("_mean")
    deviation = F.sqrt(F.try_divide(F.col("_squares"), F.col("_n")))
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    effect = F.try_divide(mean - mean * (1.0 + mde), deviation)
    return moments.select(*keys, effect.alias("effect_size"),
                          (2.0 * F.pow(F.try_divide(F.lit(z), effect), 2)).alias("sample_size"))


# Experiments on sampled logs.

def unconverted_impressions(impressions: DataFrame, donations: DataFrame,
                            key: str = "impression_id") -> DataFrame:
    """Logged impressions whose id has no donation."""
    return impressions.join(donations.select(key), key, "left_anti")


def sampled_counts(impressions: DataFrame, donations: DataFrame, keys: Sequence[str] = KEYS,
                   key: str = "impression_id") -> DataFrame:
    """Donations (all known) and logged impressions without donation, per variant."""
    failed = unconverted_impressions(impressions, donations, key).select(
        *keys, F.lit(0).cast("long").alias("_hit"))
    rows = failed.unionByName(donations.select(*keys, F.lit(1).cast("long").alias("_hit")))
    return rows.groupBy(*keys).agg(F.sum("_hit").alias("successes"),
                                   F.sum(1 - F.col("_hit")).alias("observed_failures"))


def expected_population(n: Column, rate: Column | float) -> Column:
    """Expected number of events behind n records kept at a rate."""
    return (n + 1) / (F.lit(rate) if isinstance(rate, float) else rate) - 1


def population_estimates(counts: DataFrame, rate: float, n: str = "observed_failures") -> DataFrame:
    """Expected population with its lower and upper bound."""
    return counts.select(
        "*", expected_population(F.col(n), rate).alias("expected"),
        (F.col(n) / F.lit(rate)).alias("lower_bound"),
        ((F.col(n) + 1) / F.lit(rate)).alias("upper_bound"))


def naive_posterior(counts: DataFrame, rate: float) -> DataFrame:
    """Beta parameters that take the expected failures for the true ones."""
    failures = expected_population(F.col("observed_failures"), rate).cast("long")
    return beta_posterior(counts.withColumn("failures", failures))


def inverse_binomial_pmf(counts: DataFrame, rate: float, upper: Column, n: str = "n") -> DataFrame:
    """Probability of each population from n to ``upper`` behind n records kept at a rate.

    What lies beyond ``upper`` is :func:`inverse_binomial_tail`; both together are 1.
    """
    spread = counts.withColumn("population", F.explode(F.sequence(F.col(n).cast("long"), upper)))
    missing = F.col("population") - F.col(n)
    if rate >= 1.0:
        return spread.withColumn("probability", F.when(missing == 0, 1.0).otherwise(0.0))
    log_p = (log_choose("population", n) + (F.col(n) + 1) * F.log(F.lit(rate))
             + missing * F.log(F.lit(1.0 - rate)))
    return spread.withColumn("probability", F.exp(log_p))


def inverse_binomial_tail(counts: DataFrame, rate: float, upper: Column, n: str = "n") -> DataFrame:
    """Adds tail: the probability of a population above ``upper``, in closed form.

    At most ``upper`` records behind n kept ones means more than n of upper + 1 are kept,
    which is a regularized beta function of the rate; no mass is added up.
    """
    if rate >= 1.0:
        return counts.withColumn("tail", F.lit(0.0))
    beyond = upper - F.col(n) + 1
    tail = beta_share(beyond.cast("double"), (F.col(n) + 1).cast("double"), F.lit(1.0 - rate))
    return counts.withColumn("tail", F.when(beyond > 0, tail).otherwise(1.0))


def interval_covers(lower: Column | str, upper: Column | str, lift: float) -> Column:
    """1 if the interval holds the lift, else 0."""
    low = F.col(lower) if isinstance(lower, str) else lower
    high = F.col(upper) if isinstance(upper, str) else upper
    return F.lit(lift).between(low, high).cast("int")
