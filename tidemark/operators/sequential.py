"""Sequential evaluation: a rule looked at after every fixed number of records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import draws, experiments
from tidemark.operators.ordered import next_position, rank_rows, running_totals
from tidemark.session import written

ORDER = ("ts", "impression_id")


def numbered_records(df: DataFrame, interval: int, value: str = "amount",
                     order: Sequence[str] = ORDER,
                     keys: Sequence[str] = experiments.KEYS) -> DataFrame:
    """Records with the checkpoint they count for: 1 for the first ``interval``, then 2, ...

    ``order`` must be unique within a variant.
    """
    ranked = rank_rows(df.select(*keys, *order, value), keys, order, "_rank")
    return ranked.select(*keys, F.ceil(F.col("_rank") / F.lit(interval)).cast("long").alias("checkpoint"),
                         value)


def checkpoint_counts(df: DataFrame, interval: int, value: str = "amount",
                      order: Sequence[str] = ORDER,
                      keys: Sequence[str] = experiments.KEYS, partial: bool = False) -> DataFrame:
    """Running count, conversions, sum and mean of each variant at each full checkpoint.

    With ``partial`` the records behind the last full checkpoint make one more. Squares
    are of deviations: those within a step from its own mean, those of the step means
    from the mean of the variant's first step. So nothing cancels, however large the
    values are against their spread.
    """
    x = F.col(value).cast("double")
    steps = written(numbered_records(df, interval, value, order, keys).groupBy(
        *keys, "checkpoint").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((x > 0).cast("long")).alias("_hits"),
        F.sum(x).alias("_sum"), F.avg(x).alias("_mean"),
        (F.var_pop(x) * F.count(x)).alias("_within")), "steps")
    pivots = steps.groupBy(*keys).agg(F.min_by("_mean", "checkpoint").alias("_pivot"))
    full = steps if partial else steps.where(F.col("_n") == interval)
    away = F.col("_mean") - F.col("_pivot")
    running = running_totals(full.join(pivots, list(keys)), keys, ["checkpoint"], {
        "n": F.col("_n"), "successes": F.col("_hits"), "total": F.col("_sum"),
        "_away": F.col("_n") * away, "squares": F.col("_within") + F.col("_n") * away * away,
    }, position="checkpoint")
    mean = F.col("total") / F.col("n")
    return running.select(
        *keys, "checkpoint", "n", "successes", (F.col("n") - F.col("successes")).alias("failures"),
        "total", mean.alias("mean"),
        F.greatest(F.col("squares") - F.col("_away") * F.col("_away") / F.col("n"),
                   F.lit(0.0)).alias("ssd"))


def histogram_spans(df: DataFrame, interval: int, order: Sequence[str] = ORDER,
                    amount: str = "amount") -> DataFrame:
    """Running counts of every amount with the checkpoints (``checkpoint`` to ``until``, full
    ones of the variant) at which they hold.

    Counts change only where an amount occurs; each change is carried forward to the
    checkpoint before the next one.
    """
    keys = list(experiments.KEYS)
    numbered = numbered_records(df, interval, amount, order, keys)
    steps = numbered.groupBy(*keys, "checkpoint", F.col(amount).alias("amount")).agg(
        F.count(F.lit(1)).alias("_n"))
    last = steps.groupBy(*keys).agg(F.floor(F.sum("_n") / interval).alias("_last"))
    listed = experiments.with_all_amounts(
        steps.groupBy(*keys, "amount").agg(F.sum("_n").alias("n")))
    starts = listed.select(*keys, F.lit(1).cast("long").alias("checkpoint"), "amount",
                           F.lit(0).cast("long").alias("_n"))
    changes = steps.unionByName(starts).groupBy(*keys, "amount", "checkpoint").agg(
        F.sum("_n").alias("_n"))
    series = [*keys, "amount"]
    running = running_totals(changes, series, ["checkpoint"], {"n": F.col("_n")},
                             position="checkpoint")
    spans = next_position(running, series, "checkpoint", "_next").join(last, keys)
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("_last")), F.col("_last"))
    return spans.where(F.col("checkpoint") <= F.col("_last")).select(
        *keys, "checkpoint", until.alias("until"), "amount", "n")


def checkpoint_histograms(df: DataFrame, interval: int, order: Sequence[str] = ORDER,
                          amount: str = "amount") -> DataFrame:
    """Running count of every amount of the experiment, at each full checkpoint of a variant."""
    spans = histogram_spans(df, interval, order, amount)
    return spans.withColumn("checkpoint", F.explode(F.sequence("checkpoint", "until"))).select(
        *experiments.KEYS, "checkpoint", "amount", "n")


def until_longest(paired: DataFrame, max_run: float | None) -> DataFrame:
    """Checkpoints up to the first at which a variant has more than ``max_run`` records.

    That one always decides, so none behind it is looked at. Before it both variants have
    at most ``max_run`` records, and the first beyond has the fewest of those beyond.
    """
    if max_run is None:
        return paired
    reach = F.greatest("a_n", "b_n")
    last = paired.groupBy("experiment").agg(
        F.min(F.when(reach > max_run, F.col("checkpoint"))).alias("_last"))
    return paired.join(last, "experiment").where(
        F.col("_last").isNull() | (F.col("checkpoint") <= F.col("_last"))).drop("_last")


def first_decision(results: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """First checkpoint whose result is not 'continue', per experiment."""
    decided = results.where(F.col("result") != "continue")
    return decided.groupBy(*keys).agg(
        F.min("checkpoint").alias("checkpoint"),
        F.min_by("result", "checkpoint").alias("result"),
        F.min_by(F.greatest("a_n", "b_n"), "checkpoint").alias("records"))


def ttest_results(df: DataFrame, interval: int, alpha: float = 0.05, max_run: float | None = None,
                  value: str = "amount", order: Sequence[str] = ORDER) -> DataFrame:
    """Result of the t-test rule at every checkpoint."""
    counts = checkpoint_counts(df, interval, value, order)
    paired = until_longest(experiments.pair_variants(counts, ["experiment", "checkpoint"]), max_run)
    return experiments.stop_ttest(experiments.welch_t(paired), alpha, max_run)


def amount_results(df: DataFrame, interval: int, rule: Callable[[DataFrame], DataFrame],
                   order: Sequence[str] = ORDER, sample: int = draws.DRAWS, seed: int = 0,
                   max_run: float | None = None) -> DataFrame:
    """Result of a rule on the Dirichlet comparison at every checkpoint of both variants, up
    to the first beyond ``max_run`` records, where every rule decides: no draws behind it."""
    histograms = checkpoint_histograms(df, interval, order)
    if max_run is not None:
        histograms = histograms.where(F.col("checkpoint") <= int(max_run // interval) + 1)
    return rule(draws.compare_amounts(histograms, ["experiment", "checkpoint"], draws=sample, seed=seed))


def in_rounds(source: DataFrame, judge: Callable[[DataFrame], DataFrame],
              conclude: Callable[[DataFrame], DataFrame], until: str = "checkpoint",
              first: int = 8) -> DataFrame:
    """First decisions, looking at twice as many checkpoints each time and only at experiments
    that are not decided yet.

    ``source`` has ``checkpoint`` (and ``until``, the last one a row holds for) and is read once
    a round, so it has to be a written table. ``judge`` does the costly work on the checkpoints
    of a round; ``conclude`` turns all that is judged so far into results. A checkpoint behind
    the decision is judged only if it is in the same round, so draws are at most about twice
    those needed.
    """
    last = source.agg(F.max(until)).first()[0] or 0
    low, high, judged, done = 0, first, None, None
    while True:
        here = source.where((F.col("checkpoint") <= high) & (F.col(until) > low))
        if done is not None:
            here = here.join(done, "experiment", "left_anti")
        if until != "checkpoint":
            here = here.withColumn("checkpoint", F.explode(F.sequence(
                F.greatest("checkpoint", F.lit(low + 1)), F.least(until, F.lit(high))))).drop(until)
        now = written(judge(here), "judged")
        judged = now if judged is None else judged.unionByName(now)
        decided = first_decision(conclude(judged))
        if high >= last or now.isEmpty():
            return decided
        done, low, high = decided.select("experiment"), high, 2 * high


def amount_decisions(df: DataFrame, interval: int, rule: Callable[[DataFrame], DataFrame],
                     order: Sequence[str] = ORDER, sample: int = draws.DRAWS, seed: int = 0,
                     max_run: float | None = None, first: int = 8) -> DataFrame:
    """First decision of a rule on the Dirichlet comparison; equals that of
    :func:`amount_results`, drawn for in rounds over the open experiments."""
    spans = histogram_spans(df, interval, order)
    if max_run is not None:
        longest = int(max_run // interval) + 1
        spans = spans.where(F.col("checkpoint") <= longest).withColumn(
            "until", F.least("until", F.lit(longest)))

    def judge(histograms: DataFrame) -> DataFrame:
        return draws.compare_amounts(histograms, ["experiment", "checkpoint"], draws=sample, seed=seed)

    return in_rounds(written(spans, "spans"), judge, rule, "until", first)


def streak_lengths(df: DataFrame, hit: str, name: str,
                   keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Adds the number of hits in a row up to each checkpoint; checkpoints count from 1."""
    miss_at = F.when(F.col(hit), F.lit(0)).otherwise(F.col("checkpoint"))
    last_miss = running_totals(df, keys, ["checkpoint"], {"_miss": miss_at}, largest=True,
                               position="checkpoint")
    return last_miss.withColumn(name, F.col("checkpoint") - F.col("_miss")).drop("_miss")


def _streak_parts(df: DataFrame, interval: int, conf: float, consecutives: int,
                  max_run: float | None, value: str, order: Sequence[str], sample: int, seed: int):
    """What the streak rule looks at, its draws, and its results from them."""
    counts = experiments.beta_posterior(checkpoint_counts(df, interval, value, order))
    paired = until_longest(experiments.pair_variants(counts, ["experiment", "checkpoint"]), max_run)

    def judge(rows: DataFrame) -> DataFrame:
        return draws.compare(rows, draws.rate_draws, ["experiment", "checkpoint"], sample, seed).withColumn(
            "_better", F.col("p_a_better") > conf).withColumn(
            "_worse", (1.0 - F.col("p_a_better")) > conf)

    def conclude(judged: DataFrame) -> DataFrame:
        streaks = judged
        for hit, name in (("_better", "better_streak"), ("_worse", "worse_streak")):
            streaks = streak_lengths(streaks, hit, name)
        return streaks.withColumn("result", experiments.stop_result(
            F.col("better_streak") >= consecutives, F.col("worse_streak") >= consecutives, max_run))

    return paired, judge, conclude


def streak_results(df: DataFrame, interval: int, conf: float, consecutives: int = 1,
                   max_run: float | None = None, value: str = "amount",
                   order: Sequence[str] = ORDER, sample: int = draws.DRAWS, seed: int = 0) -> DataFrame:
    """Streak rule at every checkpoint.

    A is better (or worse) once P(lift > 0) (or P(lift < 0)) exceeds ``conf`` at so
    many checkpoints in a row. ``result`` is 'A', 'B', 'unknown' past the longest
    run, else 'continue'.
    """
    paired, judge, conclude = _streak_parts(
        df, interval, conf, consecutives, max_run, value, order, sample, seed)
    return conclude(judge(paired))


def streak_decisions(df: DataFrame, interval: int, conf: float, consecutives: int = 1,
                     max_run: float | None = None, value: str = "amount",
                     order: Sequence[str] = ORDER, sample: int = draws.DRAWS, seed: int = 0,
                     first: int = 8) -> DataFrame:
    """First decision of the streak rule, drawn for in rounds over the open experiments."""
    paired, judge, conclude = _streak_parts(
        df, interval, conf, consecutives, max_run, value, order, sample, seed)
    return in_rounds(written(paired, "paired"), judge, conclude, first=first)


def baseline_checkpoint(df: DataFrame, interval: int, min_effect: float, variant: str = "A",
                        value: str = "amount", order: Sequence[str] = ORDER,
                        sample: int = draws.DRAWS, seed: int = 0) -> DataFrame:
    """First checkpoint at which the rate of one variant is known well enough.

    Well enough: its mean is above a low percentile (100 x ``min_effect``) by at most
    ``min_effect`` of that percentile.
    """
    counts = checkpoint_counts(df.where(F.col("variant") == variant), interval, value, order)
    judged = draws.rate_quantile(counts, ["experiment", "checkpoint"], 100.0 * min_effect, sample, seed)
    close = F.col("drawn_mean") - F.col("drawn_quantile") <= min_effect * F.col("drawn_quantile")
    return judged.where(close).groupBy("experiment").agg(
        F.min("checkpoint").alias("checkpoint"), F.min("n").alias("records"),
        F.min_by("drawn_mean", "checkpoint").alias("rate"),
        F.min_by("drawn_quantile", "checkpoint").alias("low_rate"))
