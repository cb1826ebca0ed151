"""Posterior draws: small sampling helpers inside Spark tasks.

Each input row holds the sums of one experiment (or one checkpoint of it), and no
records travel to Python. Rows are spread by their keys over all shuffle partitions; a
task draws for a bounded block of them at once, as one matrix with a row of draws each.
The random stream of a row depends on the seed and the row's key alone: results do not
change with the partitioning or when a task is run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.experiments import stop_result

DRAWS = 10_000
COMPARED = ("mean_a double, mean_b double, p_a_better double, cost_a double, cost_b double, "
            "lift_lower double, lift_upper double")


def generator(seed: int, *key) -> np.random.Generator:
    """Random stream of one key: 128 bits of a digest of its parts, each with its length."""
    parts = [str(part).encode() for part in key]
    named = b"".join(len(part).to_bytes(8, "big") + part for part in parts)
    digest = hashlib.blake2b(named, digest_size=16).digest()
    return np.random.default_rng([seed, int.from_bytes(digest, "big")])


def compared(a: np.ndarray, b: np.ndarray, conf: float = 90.0) -> tuple[np.ndarray, ...]:
    """Means, P(A > B), expected cost of each choice, interval of B's lift over A in percent.

    The last axis counts the draws; the results have the axes before it.
    """
    tail = (100.0 - conf) / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        lift = (b - a) / a * 100.0
    low, high = np.percentile(lift, [tail, 100.0 - tail], axis=-1)
    return (a.mean(-1), b.mean(-1), (a > b).mean(-1), np.maximum(b - a, 0.0).mean(-1),
            np.maximum(a - b, 0.0).mean(-1), low, high)


# Samplers: from the random streams and posterior parameters of a block of rows to one row of
# draws each. ``rows`` maps column names to arrays.

def _sampled(streams: Sequence[np.random.Generator], method: str, size: int, *parameters) -> np.ndarray:
    """One row of draws for each stream, by the named method with the row's own parameters."""
    return np.stack([getattr(rng, method)(*row, size)
                     for rng, *row in zip(streams, *parameters, strict=True)])


def normal_draws(streams, rows: dict, side: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances from the posterior parameters of the rows."""
    gamma = _sampled(streams, "standard_gamma", size, rows[f"{side}_v_n"] / 2.0)
    variance = (rows[f"{side}_v_n_s_sq_n"] / 2.0)[:, None] / gamma
    deviation = np.sqrt(variance / rows[f"{side}_k_n"][:, None])
    return rows[f"{side}_m_n"][:, None] + deviation * _sampled(streams, "standard_normal", size), variance


def lognormal_mean_draws(streams, rows, side, size):
    """Means of a log-normal whose log has the rows' posterior."""
    mean, variance = normal_draws(streams, rows, side, size)
    return np.exp(mean + variance / 2.0)


def hurdle_mean_draws(streams, rows, side, size):
    """Means over all rows when only some are positive."""
    positive, n = rows[f"{side}_positive"], rows[f"{side}_n"]
    rate = _sampled(streams, "beta", size, positive + 1.0, n - positive + 1.0)
    return rate * lognormal_mean_draws(streams, rows, side, size)


def rate_draws(streams, rows, side, size):
    """Conversion rates from the Beta parameters of the rows."""
    return _sampled(streams, "beta", size, rows[f"{side}_alpha"], rows[f"{side}_beta"])


def sampled_rate_draws(rate: float) -> Callable:
    """Conversion rates when failures were logged at a rate: the unlogged ones vary too."""
    def draw(streams, rows, side, size):
        successes, seen = rows[f"{side}_successes"], rows[f"{side}_observed_failures"]
        unseen = np.stack([rng.negative_binomial(n, rate, size) if n > 0 else np.zeros(size)
                           for rng, n in zip(streams, seen, strict=True)])
        failures = 1.0 + seen[:, None] + unseen
        return _sampled(streams, "beta", size, 1.0 + successes, failures)
    return draw


# Numbers in one matrix of draws: it bounds the rows that are drawn for at once.
MATRIX = 1 << 21


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by their keys over all shuffle partitions.

    The rows are few and small but each costs thousands of draws, so partitions must not be
    merged because of their size: their number is given. A hash of the keys, because an
    exchange on the keys themselves is left out after a grouping by them, whose own is merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                          F.xxhash64(*keys))


def _blocks(batches: Iterator[pd.DataFrame], keys: Sequence[str], numbers: Sequence[str], size: int
            ) -> Iterator[tuple[pd.DataFrame, list, dict]]:
    """Bounded blocks of rows with their keys and number columns."""
    at_once = max(1, MATRIX // size)
    for batch in batches:
        for begin in range(0, len(batch), at_once):
            block = batch.iloc[begin:begin + at_once].reset_index(drop=True)
            named = list(zip(*(block[k].tolist() for k in keys), strict=True))
            yield block, named, {c: block[c].to_numpy(np.float64, na_value=np.nan) for c in numbers}


def _numbers(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in keys]


def _with_results(df: DataFrame, keys: Sequence[str], added: str, work: Callable, size: int) -> DataFrame:
    """Adds columns that ``work(keys, columns)`` computes for a block of rows at once."""
    results = T._parse_datatype_string(added).fields
    schema = T.StructType(df.schema.fields + results)
    numbers = _numbers(df, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, named, columns in _blocks(batches, keys, numbers, size):
            values = work(named, columns)
            yield block.assign(**{f.name: v for f, v in zip(results, values, strict=True)})

    return _spread(df, keys).mapInPandas(run, schema)


def _streams(seed: int, named: list, *suffix: str) -> list[np.random.Generator]:
    return [generator(seed, *key, *suffix) for key in named]


def compare(paired: DataFrame, draw: Callable, keys: Sequence[str] = ("experiment",),
            draws: int = DRAWS, seed: int = 0, conf: float = 90.0) -> DataFrame:
    """Compares two variants by draws of a quantity; see :func:`compared`."""
    def work(named, rows):
        return compared(*(draw(_streams(seed, named, side), rows, side, draws) for side in "ab"), conf)
    return _with_results(paired, keys, COMPARED, work, draws)


def compare_normal(paired: DataFrame, keys: Sequence[str] = ("experiment",), draws: int = DRAWS,
                   seed: int = 0) -> DataFrame:
    """P(mean of A is greater) and P(variance of A is greater)."""
    def work(named, rows):
        mean_a, var_a = normal_draws(_streams(seed, named, "a"), rows, "a", draws)
        mean_b, var_b = normal_draws(_streams(seed, named, "b"), rows, "b", draws)
        return (mean_a > mean_b).mean(-1), (var_a > var_b).mean(-1)
    return _with_results(paired, keys, "p_mean_a_greater double, p_variance_a_greater double", work, draws)


def posterior_draws(posterior: DataFrame, keys: Sequence[str], draws: int = DRAWS,
                    seed: int = 0) -> DataFrame:
    """The normal posterior's draws themselves: (keys, draw, mu, sigma_sq)."""
    fields = [posterior.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("draw", T.IntegerType()),
                           T.StructField("mu", T.DoubleType()), T.StructField("sigma_sq", T.DoubleType())])
    numbers = _numbers(posterior, keys)

    def run(batches):
        for block, named, columns in _blocks(batches, keys, numbers, draws):
            rows = {f"x_{name}": values for name, values in columns.items()}
            mu, variance = normal_draws(_streams(seed, named), rows, "x", draws)
            out = block[list(keys)].loc[block.index.repeat(draws)].reset_index(drop=True)
            yield out.assign(draw=np.tile(np.arange(draws, dtype=np.int32), len(block)),
                             mu=mu.ravel(), sigma_sq=variance.ravel())

    return _spread(posterior, keys).mapInPandas(run, schema)


def rate_interval(counts: DataFrame, keys: Sequence[str], a: float = 5.0, draws: int = DRAWS,
                  seed: int = 0) -> DataFrame:
    """100 - a percent interval of a rate around the observed rate."""
    def work(named, rows):
        hits, misses = rows["successes"], rows["failures"]
        drawn = _sampled(_streams(seed, named), "beta", draws, hits + 1.0, misses + 1.0)
        low, high = np.percentile(drawn, [a / 2.0, 100.0 - a / 2.0], axis=-1)
        with np.errstate(invalid="ignore"):
            return low, hits / (hits + misses), high
    return _with_results(counts, keys, "rate_lower double, rate double, rate_upper double", work, draws)


def rate_quantile(counts: DataFrame, keys: Sequence[str], percentile: float, draws: int = DRAWS,
                  seed: int = 0) -> DataFrame:
    """Mean and one percentile of the posterior of a rate."""
    def work(named, rows):
        drawn = _sampled(_streams(seed, named), "beta", draws, rows["successes"] + 1.0,
                         rows["failures"] + 1.0)
        return drawn.mean(-1), np.percentile(drawn, percentile, axis=-1)
    return _with_results(counts, keys, "drawn_mean double, drawn_quantile double", work, draws)


def zero_inflated_lognormal(stats: DataFrame, keys: Sequence[str], sigma_range=(0.1, 1.5),
                            mu_prior=(0.1, 0.01), points: int = 2000) -> DataFrame:
    """Posterior means and deviations of the zero share, mu and sigma.

    The data enter through counts and log sums only. The zero share is Beta; mu is
    normal given sigma and is integrated out; sigma, uniform on its range, is
    summed over a grid. ``mu_prior`` is mean and precision.
    """
    sigma = np.linspace(*sigma_range, points)
    prior_mean, prior_precision = mu_prior

    def work(named, rows):
        some = rows["positive"] > 0
        mean, ssd = (np.where(some, rows[c], 0.0)[:, None] for c in ("log_mean", "log_ssd"))
        positive, zeros = rows["positive"][:, None], rows["n"] - rows["positive"]
        precision = positive / sigma ** 2 + prior_precision
        center = (positive * mean / sigma ** 2 + prior_precision * prior_mean) / precision
        spread = positive * prior_precision / (positive + prior_precision * sigma ** 2)
        log_weight = (-positive * np.log(sigma) - ssd / (2 * sigma ** 2) - 0.5 * np.log(precision)
                      - 0.5 * spread * (mean - prior_mean) ** 2)
        weight = np.exp(log_weight - log_weight.max(-1, keepdims=True))
        weight /= weight.sum(-1, keepdims=True)
        mu_mean, sigma_mean = (weight * center).sum(-1), weight @ sigma
        mu_var = (weight * (1.0 / precision + center ** 2)).sum(-1) - mu_mean ** 2
        sigma_var = weight @ sigma ** 2 - sigma_mean ** 2
        total = rows["n"] + 2.0
        p = (zeros + 1.0) / total
        return (p, np.sqrt(p * (1 - p) / (total + 1)), mu_mean, np.sqrt(np.maximum(mu_var, 0)),
                sigma_mean, np.sqrt(np.maximum(sigma_var, 0)))

    return _with_results(stats, keys, "p_zero double, p_zero_sd double, mu double, mu_sd double, "
                                      "sigma double, sigma_sd double", work, points)


def dirichlet_mean(histogram: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Exact posterior mean of the mean amount."""
    weight = F.col("n") + F.lit(alpha)
    return histogram.groupBy(*keys).agg(
        F.try_divide(F.sum(weight * F.col("amount")), F.sum(weight)).alias("mean_amount"),
        F.sum("n").alias("n"))


# Amounts of a group that one task draws for.
CHUNK = 1024


def _gamma_sums(seed: int, key: Sequence, rows: pd.DataFrame, variant: str, alpha: float,
                size: int, sums: dict) -> None:
    """Adds the draws of some amounts to the sums of their variants, in place.

    A Dirichlet draw is a set of gamma draws over their sum, so sums of any parts of the
    amounts add up to those of the whole. Every amount has its own random stream.
    """
    for name, amount, n in rows[[variant, "amount", "n"]].itertuples(index=False):
        if name in sums:
            held = sums[name]
            drawn = generator(seed, *key, name, amount).standard_gamma(n + alpha, size)
            held[0] += int(n)
            held[1] += drawn
            held[2] += drawn * float(amount)


def compare_amounts(histogram: DataFrame, keys: Sequence[str] = ("experiment",),
                    variant: str = "variant", a: str = "A", b: str = "B", alpha: float = 1.0,
                    draws: int = DRAWS, seed: int = 0, conf: float = 90.0,
                    chunk: int = CHUNK) -> DataFrame:
    """Compares mean amounts under a Dirichlet posterior over the listed amounts.

    ``histogram`` has one row per (keys, variant, amount). The amounts of a group are dealt
    into chunks of about ``chunk`` by a hash, and each chunk is drawn for in a task of its
    own: it gives partial sums per draw, which are added up in the order of the chunks. A
    group of one chunk is finished where it is drawn and only its result goes on.
    """
    kinds = {k: histogram.schema[k].dataType.simpleString() for k in keys}
    fields = ", ".join(f"{k} {kind}" for k, kind in kinds.items())
    compared_names = [c.split()[0] for c in COMPARED.split(", ")]
    parts = [f"_{side}_{what}" for side in "ab" for what in ("n", "weight", "weighted")]

    def result(key: tuple, sums: dict) -> list | None:
        if not (sums[a][0] and sums[b][0]):
            return None
        return [*key, sums[a][0], sums[b][0],
                *map(float, compared(sums[a][2] / sums[a][1], sums[b][2] / sums[b][1], conf))]

    def empty() -> dict:
        return {name: [0, np.zeros(draws), np.zeros(draws)] for name in (a, b)}

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *key, chunks, number = key
        sums = empty()
        _gamma_sums(seed, key, rows.sort_values([variant, "amount"]), variant, alpha, draws, sums)
        done = result(key, sums) if chunks == 1 else None
        columns = [*keys, "a_n", "b_n", *compared_names, "_chunks", "_chunk", *parts]
        rest = [int(chunks), int(number), *sums[a], *sums[b]] if chunks > 1 else [
            int(chunks), int(number), *[None] * len(parts)]
        whole = done or [*key, *[None] * (2 + len(compared_names))]
        if chunks == 1 and done is None:
            return pd.DataFrame([], columns=columns)
        return pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in
                             zip(columns, [*whole, *rest], strict=True)})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = empty()
        for batch in batches:
            finished = batch[batch["_chunks"] == 1]
            if len(finished):
                yield finished[[*keys, "a_n", "b_n", *compared_names]]
                return
            for row in batch[parts].itertuples(index=False):
                for at, name in enumerate((a, b)):
                    n, weight, weighted = row[3 * at:3 * at + 3]
                    sums[name][0] += int(n)
                    sums[name][1] += weight
                    sums[name][2] += weighted
        whole = result(key, sums)
        if whole:
            yield pd.DataFrame([whole], columns=[*keys, "a_n", "b_n", *compared_names])

    light = histogram.select(*keys, variant, "amount", "n")
    sizes = light.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * chunk)).cast("int").alias(
        "_chunks")).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    dealt = light.join(sizes, same).drop(*(f"_key_{k}" for k in keys)).withColumn(
        "_chunk", F.pmod(F.xxhash64("amount"), F.col("_chunks")).cast("int"))
    arrays = ", ".join(f"{c} long" if c.endswith("_n") else f"{c} array<double>" for c in parts)
    final = f"{fields}, a_n long, b_n long, {COMPARED}"
    drawn = dealt.groupBy(*keys, "_chunks", "_chunk").applyInPandas(
        draw, f"{final}, _chunks int, _chunk int, {arrays}")
    in_order = drawn.repartition(*keys).sortWithinPartitions(*keys, "_chunk")
    return in_order.groupBy(*keys).applyInPandas(add, final)


def stop_credibility(compared_rows: DataFrame, conf: float, max_run: float | None = None) -> DataFrame:
    """Decides once one variant is better with more than the given probability."""
    p = F.col("p_a_better")
    return compared_rows.withColumn("result", stop_result(p > conf, (1.0 - p) > conf, max_run))


def stop_expected_cost(compared_rows: DataFrame, cost: float, max_run: float | None = None) -> DataFrame:
    """Decides for the larger mean once the expected cost of a wrong choice is small."""
    prefers_a: Column = F.col("mean_a") > F.col("mean_b")
    return compared_rows.withColumn("result", stop_result(
        prefers_a & (F.col("cost_a") < cost), ~prefers_a & (F.col("cost_b") < cost), max_run))
