"""A sequential test over a stream of experiment records, with its own state per experiment.

Records are summed where they are read: what goes on is a few rows per task, experiment and
variant. A stateful operator keeps one row per experiment in the state store: counts, means and
squared deviations of both variants, the number of checkpoints so far and whether the experiment
is decided. A checkpoint is a micro-batch that has records of the experiment. A decided
experiment is not tested again, whatever comes later; with ``patience`` an experiment that is
still open so long (in event time) after its first record is closed as 'unknown' by a timer.

Results are appended by Spark's file sink, which commits a batch once however often it is run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.numbers import two_sided_t
from tidemark.operators.sequential import first_decision

SIDES = ("a", "b")
SUMS = ("n", "mean", "ssd")
RESULT = ("checkpoint long, a_n long, b_n long, a_mean double, b_mean double, a_ssd double, "
          "b_ssd double, t double, dof double, p double, result string")
STATE = ("checkpoint long, a_n long, a_mean double, a_ssd double, b_n long, b_mean double, "
         "b_ssd double, since long, decided boolean")


def merged(one: tuple, two: tuple) -> tuple[int, float, float]:
    """Count, mean and squared deviations of two sets of numbers together."""
    n = one[0] + two[0]
    if not n:
        return 0, 0.0, 0.0
    away = two[1] - one[1]
    return (n, one[1] + away * two[0] / n,
            one[2] + two[2] + away * away * one[0] * two[0] / n)


def batch_sums(stream: DataFrame, value: str = "amount", ts: str | None = None) -> DataFrame:
    """Count, mean and squared deviations per experiment and variant of every Arrow batch."""
    kind = stream.schema["experiment"].dataType.simpleString()
    moment = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    light = stream.select("experiment", "variant", F.col(value).cast("double").alias("x"),
                          moment.alias("ts")).where("experiment IS NOT NULL")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch.dropna(subset=["x"])
            grouped = known.groupby(["experiment", "variant"], sort=False)
            sums = grouped["x"].agg(["count", "mean"])
            sums["ssd"] = (known["x"] - grouped["x"].transform("mean")).pow(2).groupby(
                [known["experiment"], known["variant"]], sort=False).sum()
            sums["ts"] = grouped["ts"].max()
            yield sums.reset_index().rename(columns={"count": "n"})

    return light.mapInPandas(
        summed, f"experiment {kind}, variant string, n long, mean double, ssd double, ts timestamp")


def welch(a: tuple, b: tuple) -> tuple[float | None, float | None, float | None]:
    """Welch's t, degrees of freedom and p-value; None without any variance."""
    parts = [ssd / n / n for n, _, ssd in (a, b)]
    spread = sum(parts)
    if spread == 0:
        return None, None, None
    t = (a[1] - b[1]) / np.sqrt(spread)
    dof = spread ** 2 / sum(p * p / (s[0] - 1) for p, s in zip(parts, (a, b), strict=True))
    return float(t), float(dof), float(two_sided_t([t], [dof])[0])


def verdict(a: tuple, b: tuple, p: float | None, alpha: float, max_run: float | None) -> str:
    """'A' or 'B' once p is below alpha, 'unknown' past the longest run, else 'continue'."""
    if p is not None and p < alpha:
        return "A" if a[1] > b[1] else "B"
    return "unknown" if max_run is not None and max(a[0], b[0]) > max_run else "continue"


def _tester(names: dict, alpha: float, max_run: float | None, patience: int | None):
    fields = [f.name for f in T._parse_datatype_string(RESULT).fields]

    def row(key: tuple, held: dict, tested: tuple, result: str) -> pd.DataFrame:
        a, b = ([held[f"{s}_{c}"] for c in SUMS] for s in SIDES)
        values = (held["checkpoint"], a[0], b[0], a[1], b[1], a[2], b[2], *tested, result)
        out = pd.DataFrame([values], columns=fields).astype(
            {c: "float64" for c in ("t", "dof", "p")})
        out.insert(0, "experiment", key[0])
        return out

    def test(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in STATE.split(", ")]
        held = dict(zip(columns, state.get, strict=True)) if state.exists else dict(
            zip(columns, (0, 0, 0.0, 0.0, 0, 0.0, 0.0, None, False), strict=True))
        if state.hasTimedOut:
            if not held["decided"]:
                held["decided"] = True
                state.update(tuple(held.values()))
                yield row(key, held, (None, None, None), "unknown")
            return
        if held["decided"]:
            return  # counted no more and tested no more
        first = held["since"]
        rows = pd.concat(list(batches))
        # Floating-point sums follow the order; this one does not depend on the tasks.
        rows = rows.sort_values(["variant", "n", "mean", "ssd"], kind="stable")
        for name, n, mean, ssd in rows[["variant", "n", "mean", "ssd"]].itertuples(index=False):
            if name in names:
                side = names[name]
                both = merged(tuple(held[f"{side}_{c}"] for c in SUMS), (int(n), mean, ssd))
                held.update(zip((f"{side}_{c}" for c in SUMS), both, strict=True))
        if patience is not None and rows["ts"].notna().any():
            here = int(rows["ts"].min().timestamp() * 1000)
            held["since"] = here if first is None else min(first, here)
        held["checkpoint"] += 1
        a, b = (tuple(held[f"{s}_{c}"] for c in SUMS) for s in SIDES)
        results = []
        if a[0] > 1 and b[0] > 1:
            tested = welch(a, b)
            result = verdict(a, b, tested[2], alpha, max_run)
            held["decided"] = result != "continue"
            results.append(row(key, held, tested, result))
        state.update(tuple(held.values()))
        if patience is not None and not held["decided"] and held["since"] is not None:
            end = held["since"] + patience
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield from results
    return test


def tested_stream(stream: DataFrame, alpha: float = 0.05, max_run: float | None = None,
                  value: str = "amount", a: str = "A", b: str = "B", ts: str | None = None,
                  patience_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """One row for every checkpoint of an experiment that was open before it.

    ``patience_ms`` needs the event time ``ts``; ``delay`` is how late records may be.
    """
    sums = batch_sums(stream, value, ts)
    if patience_ms is not None:
        sums = sums.withWatermark("ts", delay)
    kind = stream.schema["experiment"].dataType.simpleString()
    timeout = (GroupStateTimeout.NoTimeout if patience_ms is None
               else GroupStateTimeout.EventTimeTimeout)
    return sums.groupBy("experiment").applyInPandasWithState(
        _tester({a: "a", b: "b"}, alpha, max_run, patience_ms),
        f"experiment {kind}, {RESULT}", STATE, "append", timeout)


def monitor_experiments(stream: DataFrame, path: str, checkpoint: str, alpha: float = 0.05,
                        max_run: float | None = None, value: str = "amount",
                        ts: str | None = None, patience_ms: int | None = None,
                        **trigger) -> StreamingQuery:
    """Appends the result of the t-test rule for every open experiment a micro-batch changed."""
    tested = tested_stream(stream, alpha, max_run, value, ts=ts, patience_ms=patience_ms)
    return (tested.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def monitored_results(spark: SparkSession, path: str) -> DataFrame:
    """All results written so far; ``checkpoint`` counts an experiment's micro-batches."""
    return spark.read.parquet(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """First decision of each experiment so far: its last row, as none follows it."""
    return first_decision(monitored_results(spark, path))
