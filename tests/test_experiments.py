"""Experiment statistics, draws and sequential rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.operators import draws, ordered, sequential
from tidemark.operators import experiments as ex

RECORD = "impression_id LONG, ts LONG, experiment STRING, variant STRING, amount LONG"


def records(spark, seed=1, n=3000, p=(0.3, 0.2), experiments=("x",)):
    rng = np.random.default_rng(seed)
    rows, number = [], 0
    for name in experiments:
        for variant, rate in zip("AB", p):
            for hit, value in zip(rng.random(n) < rate, rng.integers(1, 4, n)):
                rows.append((number, number // 3, name, variant, int(hit * value * 5)))
                number += 1
    return spark.createDataFrame(rows, RECORD)


def test_t_distribution():
    # Table values: t quantiles at two-sided 5 %, and closed forms for 1 and 2 degrees.
    assert numbers.two_sided_t([12.706204736, 2.228138852, 1.959963985], [1, 10, 1e9]) == pytest.approx(
        [0.05] * 3, abs=1e-7)
    assert numbers.two_sided_t([1.0], [1.0])[0] == pytest.approx(0.5)
    assert numbers.two_sided_t([2.0], [2.0])[0] == pytest.approx(1 - 2 / math.sqrt(6))
    assert np.isnan(numbers.two_sided_t([np.nan, 1.0], [3.0, np.nan])).all()
    assert numbers.regularized_beta([2.0], [3.0], [0.4])[0] == pytest.approx(0.5248)


def test_log_choose(spark):
    df = spark.createDataFrame([(5, 2), (100, 50), (7, 0)], "n LONG, k LONG")
    found = [r[0] for r in df.select(numbers.log_choose("n", "k")).collect()]
    assert found == pytest.approx([math.log(10), math.log(math.comb(100, 50)), 0.0])


def test_welch_by_hand(spark):
    rows = [(i, i, "x", v, a) for v, xs in (("A", (1, 2, 3, 6)), ("B", (2, 2, 5))) for i, a in enumerate(xs)]
    tested = ex.welch_t(ex.pair_variants(ex.sufficient_statistics(
        spark.createDataFrame(rows, RECORD), "amount"))).first()
    va, vb = np.var([1, 2, 3, 6]) / 4, np.var([2, 2, 5]) / 3
    assert tested.t == pytest.approx((3 - 3) / math.sqrt(va + vb))
    assert tested.dof == pytest.approx((va + vb) ** 2 / (va ** 2 / 3 + vb ** 2 / 2))
    assert tested.p == pytest.approx(1.0)


def test_no_conversions_go_on(spark):
    rows = [(i, i, "x", "AB"[i % 2], 0) for i in range(40)]
    results = sequential.ttest_results(spark.createDataFrame(rows, RECORD), 5, 0.05)
    assert {(r.p, r.result) for r in results.collect()} == {(None, "continue")}
    assert sequential.first_decision(results).count() == 0


def test_large_values_do_not_cancel(spark):
    rows = [(i, i, "x", "AB"[i % 2], 10_000_000 + i // 2 % 2) for i in range(4000)]
    counts = sequential.checkpoint_counts(spark.createDataFrame(rows, RECORD), 100).collect()
    assert len(counts) == 40
    assert all(r.ssd == pytest.approx(r.n / 4, rel=1e-9) for r in counts)
    sizes = ex.sample_size(ex.amount_histogram(spark.createDataFrame(rows, RECORD)), 0.05)
    assert all(r.effect_size == pytest.approx(-0.05 * 10_000_000.5 / 0.5, rel=1e-9) for r in sizes.collect())


def test_last_records_can_count(spark):
    df = records(spark, n=130)
    assert sequential.checkpoint_counts(df, 100).where("variant = 'A'").count() == 1
    last = sequential.checkpoint_counts(df, 100, partial=True).where("variant = 'A'").orderBy("checkpoint").collect()[-1]
    assert last.n == df.where("variant = 'A'").count()


def test_streams_differ_by_every_part():
    first = {int(draws.generator(0, *key).integers(1 << 62)) for key in
             [("a", "b"), ("ab", ""), ("a|b",), ("", "ab"), *((n,) for n in range(2000))]}
    assert len(first) == 2004


def test_checkpoints_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_WIDTH", 3)
    df = records(spark, n=1030)
    counts = {(r.variant, r.checkpoint): r for r in sequential.checkpoint_counts(df, 100).collect()}
    rows = {v: [r.amount for r in df.where(F.col("variant") == v).orderBy("ts", "impression_id").collect()]
            for v in "AB"}
    assert len(counts) == 20
    for (variant, checkpoint), row in counts.items():
        seen = np.array(rows[variant][:100 * checkpoint])
        assert (row.n, row.successes, row.total) == (len(seen), (seen > 0).sum(), seen.sum())
        assert row.ssd == pytest.approx(((seen - seen.mean()) ** 2).sum())
    histograms = sequential.checkpoint_histograms(df, 100).collect()
    assert len(histograms) == 20 * 4
    for row in histograms:
        assert row.n == rows[row.variant][:100 * row.checkpoint].count(row.amount)


def test_ttest_decides_for_the_better(spark):
    df = records(spark, p=(0.5, 0.2))
    first = sequential.first_decision(sequential.ttest_results(df, 100, 0.001)).first()
    assert first.result == "A" and first.records == 100 * first.checkpoint < 3000
    same = records(spark, n=600, p=(0.3, 0.3))
    unknown = sequential.first_decision(sequential.ttest_results(same, 100, 1e-9, 250)).first()
    assert (unknown.result, unknown.records) == ("unknown", 300)


def test_bayesian_rules_agree_on_a_clear_case(spark):
    df = records(spark, p=(0.2, 0.5))
    for rule in (lambda r: draws.stop_credibility(r, 0.99), lambda r: draws.stop_expected_cost(r, 0.001)):
        first = sequential.first_decision(sequential.amount_results(df, 250, rule, sample=2000)).first()
        assert first.result == "B"
    streak = sequential.first_decision(sequential.streak_results(df, 250, 0.95, 3, sample=2000)).first()
    assert streak.result == "B" and streak.checkpoint >= 3


def test_streaks_restart_after_a_miss(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_WIDTH", 2)
    hits = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("x", i, bool(h)) for i, h in enumerate(hits, 1)],
                               "experiment STRING, checkpoint LONG, hit BOOLEAN")
    found = sequential.streak_lengths(df, "hit", "streak").orderBy("checkpoint")
    assert [r.streak for r in found.collect()] == [1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_baseline_waits_for_a_narrow_posterior(spark):
    df = records(spark, n=2000, p=(0.5, 0.5))
    row = sequential.baseline_checkpoint(df, 50, 0.1).first()
    n = row.records
    sd = math.sqrt(0.25 / n)
    assert 1.28 * sd / 0.5 == pytest.approx(0.1, rel=0.35)
    assert row.low_rate < row.rate


def normal_row(n, mean, sd):
    return dict(a_k_n=n + 1.0, a_m_n=mean, a_v_n=n + 1.0, a_v_n_s_sq_n=n * sd ** 2)


def test_normal_draws_have_posterior_moments():
    row = normal_row(400, 4.0, 0.9)
    columns = {name: np.array([value, value], float) for name, value in row.items()}
    both = draws.normal_draws([draws.generator(1, key) for key in "jk"], columns, "a", 40_000)
    assert all(drawn.shape == (2, 40_000) and (drawn[0] != drawn[1]).all() for drawn in both)
    mu, variance = (drawn[1] for drawn in both)
    assert mu.mean() == pytest.approx(4.0, abs=4 * 0.045 / 200)
    assert variance.mean() == pytest.approx(row["a_v_n_s_sq_n"] / (row["a_v_n"] - 2), rel=0.01)


def test_streams_depend_on_the_key_only(spark):
    df = ex.beta_posterior(spark.createDataFrame(
        [(f"e{i}", v, 30 + i, 70) for i in range(12) for v in "AB"],
        "experiment STRING, variant STRING, successes LONG, failures LONG"))
    paired = ex.pair_variants(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in ("1", "6"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spread = draws.compare(paired, draws.rate_draws, draws=500)
        # Not merged for being small: each row is dear.
        assert spread.rdd.getNumPartitions() == int(parts)
        found.append(spread.collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    one, many = found
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert len({r.p_a_better for r in one}) > 1


def test_blocks_of_rows_draw_as_single_rows_do(spark):
    paired = spark.createDataFrame([(f"e{i}", 30.0 + i, 70.0, 40.0, 60.0) for i in range(5)],
                                   "experiment STRING, a_alpha DOUBLE, a_beta DOUBLE, b_alpha DOUBLE, b_beta DOUBLE")
    size = draws.MATRIX // 2  # two rows a block
    whole = draws.compare(paired, draws.rate_draws, draws=size).orderBy("experiment").collect()
    alone = draws.compare(paired.where("experiment = 'e3'"), draws.rate_draws, draws=size).first()
    assert [r.experiment for r in whole] == [f"e{i}" for i in range(5)] and whole[3] == alone
    assert draws.compare(paired.limit(0), draws.rate_draws).count() == 0


def exact_beta_greater(a1, b1, a2, b2):
    """P(X > Y) for Beta(a1, b1), Beta(a2, b2) with whole a1."""
    lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return sum(math.exp(lb(a2 + i, b1 + b2) - math.log(b1 + i) - lb(1 + i, b1) - lb(a2, b2))
               for i in range(a1))


def test_beta_comparison_is_close_to_exact(spark):
    counts = spark.createDataFrame([("x", "A", 48, 352), ("x", "B", 40, 360)],
                                   "experiment STRING, variant STRING, successes LONG, failures LONG")
    row = draws.compare(ex.pair_variants(ex.beta_posterior(counts)), draws.rate_draws, draws=40_000).first()
    exact = exact_beta_greater(49, 353, 41, 361)
    assert row.p_a_better == pytest.approx(exact, abs=4 * math.sqrt(0.25 / 40_000))
    swapped = counts.withColumn("variant", F.when(F.col("variant") == "A", "B").otherwise("A"))
    other = draws.compare(ex.pair_variants(ex.beta_posterior(swapped)), draws.rate_draws, draws=40_000).first()
    assert row.p_a_better + other.p_a_better == pytest.approx(1, abs=0.02)


def test_dirichlet_draws_center_on_the_exact_mean(spark):
    rows = [("x", "A", 0, 80), ("x", "A", 5, 15), ("x", "A", 20, 5), ("x", "B", 0, 90), ("x", "B", 5, 10)]
    dense = ex.with_all_amounts(spark.createDataFrame(
        rows, "experiment STRING, variant STRING, amount LONG, n LONG"))
    exact = {r.variant: r.mean_amount for r in draws.dirichlet_mean(dense, ex.KEYS).collect()}
    assert exact["B"] == pytest.approx((5 * 11 + 20) / 103)
    row = draws.compare_amounts(dense, draws=20_000).first()
    assert (row.a_n, row.b_n) == (100, 100)
    assert row.mean_a == pytest.approx(exact["A"], abs=0.03)
    assert row.mean_b == pytest.approx(exact["B"], abs=0.03)
    assert row.cost_a - row.cost_b == pytest.approx(row.mean_b - row.mean_a, abs=1e-9)


def test_lognormal_and_hurdle(spark):
    rng = np.random.default_rng(4)
    rows = [(0, 0, "x", v, float(x)) for v, mu in (("A", 4.3), ("B", 4.0))
            for x in np.concatenate([rng.lognormal(mu, 1.0, 2000), np.zeros(500)])]
    df = spark.createDataFrame(rows, RECORD.replace("amount LONG", "amount DOUBLE"))
    paired = ex.pair_variants(ex.normal_posterior(ex.sufficient_statistics(df, "amount"), on_logs=True))
    plain = draws.compare(paired, draws.lognormal_mean_draws).first()
    hurdle = draws.compare(paired, draws.hurdle_mean_draws).first()
    assert plain.p_a_better > 0.99 and hurdle.p_a_better > 0.99
    assert plain.mean_a == pytest.approx(math.exp(4.3 + 0.5), rel=0.15)
    assert hurdle.mean_a == pytest.approx(0.8 * plain.mean_a, rel=0.03)


def test_zero_inflated_fit_recovers_parameters(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.lognormal(0.4, math.sqrt(0.7), 3000), np.zeros(7000)])
    df = spark.createDataFrame([("x", "A", float(v)) for v in values],
                               "experiment STRING, variant STRING, amount DOUBLE")
    row = draws.zero_inflated_lognormal(ex.sufficient_statistics(df, "amount"), list(ex.KEYS)).first()
    assert abs(row.p_zero - 0.7) < 4 * row.p_zero_sd
    assert abs(row.mu - 0.4) < 4 * row.mu_sd and row.mu_sd < 0.05
    assert abs(row.sigma - math.sqrt(0.7)) < 4 * row.sigma_sd and row.sigma_sd < 0.05


def test_inverse_binomial_sums_to_one(spark):
    counts = spark.createDataFrame([("x", 100)], "experiment STRING, n LONG")
    pmf = ex.inverse_binomial_pmf(counts, 0.1, F.lit(4000))
    total, mean = pmf.agg(F.sum("probability"), F.sum(F.col("probability") * F.col("population"))).first()
    assert total == pytest.approx(1.0) and mean == pytest.approx(101 / 0.1 - 1)
    certain = ex.inverse_binomial_pmf(counts, 1.0, F.lit(120)).where("probability > 0").collect()
    assert [(r.population, r.probability) for r in certain] == [(100, 1.0)]


def test_sampled_rates(spark):
    counts = spark.createDataFrame([("x", "A", 80, 100), ("x", "B", 80, 100)],
                                   "experiment STRING, variant STRING, successes LONG, observed_failures LONG")
    paired = ex.pair_variants(counts)
    whole = draws.compare(paired, draws.sampled_rate_draws(1.0), draws=20_000).first()
    plain = draws.compare(ex.pair_variants(ex.beta_posterior(
        counts.withColumnRenamed("observed_failures", "failures"))), draws.rate_draws, draws=20_000).first()
    assert whole.mean_a == pytest.approx(plain.mean_a, abs=0.002)
    naive = draws.compare(ex.pair_variants(ex.naive_posterior(counts, 0.01)), draws.rate_draws).first()
    proper = draws.compare(paired, draws.sampled_rate_draws(0.01)).first()
    assert proper.lift_upper - proper.lift_lower > naive.lift_upper - naive.lift_lower


def test_interval_covers_the_true_lift_as_often_as_it_says(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(200):
        for variant, p in (("A", 0.02), ("B", 0.02 * 1.03)):
            hits = rng.binomial(100_000, p)
            rows.append((f"e{i}", variant, int(hits), int(rng.binomial(100_000 - hits, 0.01))))
    paired = ex.pair_variants(spark.createDataFrame(
        rows, "experiment STRING, variant STRING, successes LONG, observed_failures LONG"))
    covered = draws.compare(paired, draws.sampled_rate_draws(0.01), draws=2000).agg(
        F.avg(ex.interval_covers("lift_lower", "lift_upper", 3.0))).first()[0]
    assert covered == pytest.approx(0.9, abs=4 * math.sqrt(0.09 / 200))


def test_sample_size_formula(spark):
    rows = [("x", "A", 0, 8), ("x", "A", 1, 2)]
    size = ex.sample_size(spark.createDataFrame(rows, "experiment STRING, variant STRING, amount LONG, n LONG"),
                          0.05).first()
    assert size.effect_size == pytest.approx(-0.01 / 0.4)
    assert size.sample_size == pytest.approx(2 * ((1.959964 + 1.644854) / 0.025) ** 2, rel=1e-5)


def test_log_gamma_is_accurate():
    values = np.concatenate([np.arange(1, 40), [0.5, 15.999, 16.001, 1e3, 1e6, 1e9]])
    assert numbers.log_gamma(values) == pytest.approx([math.lgamma(v) for v in values], rel=1e-13, abs=1e-12)


def test_chunks_of_amounts_add_up(spark):
    rng = np.random.default_rng(8)
    rows = [(e, v, int(a), int(n)) for e, size in (("big", 300), ("small", 4), ("one", 1)) for v in "AB"
            for a, n in zip(range(size), rng.integers(0, 9, size))]
    rows += [("half", "A", 5, 3), (None, "A", 1, 2), (None, "B", 1, 2), ("big", "C", 1, 1)]
    df = spark.createDataFrame(rows, "experiment STRING, variant STRING, amount LONG, n LONG")
    whole = {r.experiment: r for r in draws.compare_amounts(df, draws=500).collect()}
    assert set(whole) == {"big", "small", None} | ({"one"} if "one" in whole else set())
    for chunk in (1, 7, 64):
        parts = {r.experiment: r for r in draws.compare_amounts(
            df.repartition(5), draws=500, chunk=chunk).collect()}
        assert set(parts) == set(whole)
        for name, row in whole.items():
            found, wanted = ([math.nan if v is None else v for v in r[1:]] for r in (parts[name], row))
            assert found == pytest.approx(wanted, rel=1e-9, nan_ok=True)


def test_rounds_equal_the_full_run_with_fewer_draws(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i, e, "AB"[i % 2], int(5 * (rng.random() < rate)), 0)
            for e, rates in (("fast", (0.3, 0.05)), ("slow", (0.20, 0.18)), ("none", (0.1, 0.1)))
            for i in range(4000) for rate in [rates[i % 2]]]
    df = spark.createDataFrame([(r[0], r[2], r[3], r[4]) for r in rows],
                               "impression_id LONG, experiment STRING, variant STRING, amount LONG").withColumn(
        "ts", F.timestamp_seconds("impression_id"))

    def rule(compared):
        return draws.stop_credibility(compared, 0.99)

    full = sequential.amount_results(df, 100, rule, sample=400)
    wanted = sorted(map(tuple, sequential.first_decision(full).collect()))
    judged = []

    def counted(compared):
        judged.append(compared.count())
        return rule(compared)

    found = sequential.amount_decisions(df, 100, counted, sample=400, first=2)
    assert sorted(map(tuple, found.collect())) == wanted
    steps = {r.experiment: r.checkpoint for r in found.collect()}
    assert steps["fast"] <= 4 and judged == sorted(judged) and judged[-1] < full.count()
    streaks = sequential.first_decision(sequential.streak_results(df, 100, 0.95, 3, sample=400))
    rounds = sequential.streak_decisions(df, 100, 0.95, 3, sample=400, first=1)
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, streaks.collect()))


@pytest.mark.parametrize("n, rate", [(0, 0.1), (3, 0.5), (40, 0.02), (7, 1.0)])
def test_mass_and_closed_tail_sum_to_one(spark, n, rate):
    counts = spark.createDataFrame([(n,)], "n LONG")
    for reach in (0, 1, 5, 60):
        upper = F.col("n") + reach
        mass = ex.inverse_binomial_pmf(counts, rate, upper).agg(F.sum("probability")).first()[0]
        tail = ex.inverse_binomial_tail(counts, rate, upper).first().tail
        assert mass + tail == pytest.approx(1, abs=1e-10)
    assert ex.inverse_binomial_tail(counts, rate, F.col("n") - 1).first().tail == (0.0 if rate == 1 else 1.0)


def test_full_run_draws_up_to_the_checkpoint_that_decides(spark, monkeypatch, tmp_path):
    """Behind the first checkpoint beyond the longest run no amounts are drawn for."""
    from tidemark.plans import draw_queries

    spark.range(6000).selectExpr(
        "id AS event_id", "timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts",
        "id * 0 AS user_id", "IF(id % 5 < 2, 'purchase', 'view') AS event_type", "1.0D AS value",
        """concat('{"k": ', id % 7, '}') AS props""").write.parquet(str(tmp_path / "events.parquet"))
    seen, real = [], draws.compare_amounts

    def seeing(histogram, *args, **kwargs):
        seen.append(histogram)
        return real(histogram, *args, **kwargs)

    monkeypatch.setattr(draws, "compare_amounts", seeing)
    found = draw_queries.decisions_are_first(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("e0", True, True)]
    assert max(h.selectExpr("max(checkpoint)").first()[0] for h in seen) <= 1000 // draw_queries.INTERVAL + 1
