"""Ranks and running totals over groups of any size.

A plain window puts a whole group into one task. Here the rows are cut into slices
along the sort order, at every size: each slice is summed on its own, and a window over
the few slice totals gives every slice its opening balance. One group may then hold any
share of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import written

SLICE = "_slice"
# Positions per slice when a dense number gives the order.
SLICE_WIDTH = 4096


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              slices: int | None) -> DataFrame:
    """Range-partitions by (keys, order), balanced whatever the key frequencies.

    ``order`` must be unique within ``keys``.
    """
    if slices is None:
        return df.repartitionByRange(*keys, *order)
    return df.repartitionByRange(slices, *keys, *order)


def cut_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 slices: int | None = None) -> DataFrame:
    """Tags each row with its slice of the total order (keys, order).

    A recomputed range partitioning may cut elsewhere, so the tagged rows are
    written to the shared folder: all later uses, also after a lost executor, see
    the same cut.
    """
    return written(_in_order(df, keys, order, slices).withColumn(SLICE, F.spark_partition_id()),
                   "slices")


def cut_by_position(df: DataFrame, position: str) -> DataFrame:
    """Tags each row with its slice of a dense number; written, as it is read twice."""
    place = F.floor(F.col(position) / F.lit(SLICE_WIDTH)).cast("int")
    return written(df.withColumn(SLICE, place), "slices")


def _same_slice(keys: Sequence[str]) -> Column:
    on = F.col(SLICE) == F.col("_key_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return on


def _per_slice(df: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    """Small table of one row per key and slice.

    Written, so that Spark knows its size and broadcasts it if that is small, and
    does not shuffle the rows it is joined to.
    """
    return written(df.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                             F.col(SLICE).alias("_key_slice"), *columns), "openings")


def sliced_totals(sliced: DataFrame, keys: Sequence[str], order: Sequence[str],
                  totals: Mapping[str, Column], largest: bool = False) -> DataFrame:
    """Running totals from rows that one of the cutting functions has tagged."""
    fold = F.max if largest else F.sum
    slice_totals = sliced.groupBy(*keys, SLICE).agg(
        *[fold(value).alias(name) for name, value in totals.items()])
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    openings = _per_slice(slice_totals, keys, *[
        fold(name).over(before).alias(f"_opening_{name}") for name in totals])
    within = (W.partitionBy(*keys, SLICE).orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    local = sliced.select(
        "*", *[fold(value).over(within).alias(name) for name, value in totals.items()])
    joined = local.join(openings, _same_slice(keys))
    combined = []
    for name in totals:
        here, opening = F.col(name), F.col(f"_opening_{name}")
        both = F.greatest(here, opening) if largest else here + F.coalesce(opening, F.lit(0))
        combined.append(both.alias(name))
    return joined.select(*[c for c in sliced.columns if c != SLICE], *combined)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   totals: Mapping[str, Column], largest: bool = False,
                   position: str | None = None) -> DataFrame:
    """Adds running totals per key in a unique order, the current row included.

    ``totals`` maps the new columns to the values to add up; with ``largest`` the
    running maximum is taken instead. ``position`` names a dense number that gives
    the order, if there is one.
    """
    sliced = cut_by_position(df, position) if position else cut_by_order(df, keys, order)
    return sliced_totals(sliced, keys, order, totals, largest)


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              name: str = "rank", slices: int | None = None) -> DataFrame:
    """Row number per key in a unique order, with one shuffle, whatever the size of a group.

    Sorted range partitions number their rows as they are written. What is left is
    to shift each key's numbers in each slice by the rows of the key in the slices
    before: a join with one row per slice and key that occurs in it.
    """
    place = "_place"
    placed = written(
        _in_order(df, keys, order, slices).sortWithinPartitions(*keys, *order)
        .withColumn(place, F.monotonically_increasing_id()), "ranked"
    ).withColumn(SLICE, F.shiftright(place, 33).cast("int"))
    runs = placed.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(place).alias("_first"))
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    shifts = _per_slice(runs, keys, (F.coalesce(F.sum("_rows").over(before), F.lit(0))
                                     - F.col("_first") + 1).alias("_shift"))
    return placed.join(shifts, _same_slice(keys)).select(
        *df.columns, (F.col(place) + F.col("_shift")).alias(name))


def next_position(df: DataFrame, keys: Sequence[str], position: str, name: str) -> DataFrame:
    """Adds the next position present for the same key, NULL for the last one."""
    sliced = cut_by_position(df, position)
    firsts = sliced.groupBy(*keys, SLICE).agg(F.min(position).alias("_first"))
    later = W.partitionBy(*keys).orderBy(SLICE)
    following = _per_slice(firsts, keys, F.lead("_first").over(later).alias("_following"))
    within = W.partitionBy(*keys, SLICE).orderBy(position)
    local = sliced.withColumn(name, F.lead(position).over(within))
    return local.join(following, _same_slice(keys)).select(
        *df.columns, F.coalesce(F.col(name), F.col("_following")).alias(name))
