"""Mixing sources to target weights by Pareto order sampling.

Native: column expressions, grouped sums and joins only. Each source gets a target of
words. A document's expected copies are its share of the target; whole copies are certain,
the fraction is its inclusion probability. Documents are ranked by random odds divided by
inclusion odds (Pareto order), and the sample is fixed in words: ranks are taken until the
words left of the target are met, to half a document.

No source is sorted whole. Ranks fall into ``BUCKETS`` buckets whose words are summed
before any shuffle; only the bucket in which a source's target is met is ordered. The
result is one cut per source, and every row is decided where it is read.

Defined cases: a null text has no words; documents without words are never short of a
target. A null source is a source of its own, last in order. Random numbers depend on seed
and id only, so reruns agree; rows with equal ids (null included) are decided alike, as one
document of their sizes together. A source without words has the target 0. Further columns
are kept; columns named as the added ones are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.names import apart
from tidemark.session import written

BUCKETS = 16384
ADDED = ("size", "source_size", "target", "copies", "taken")
INNER = ("_key", "_of", "_whole", "_chance", "_rank", "_bucket", "_cut_bucket", "_cut")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest of seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float,
                   most: float) -> DataFrame:
    """One row per source: source, source_size, target.

    ``weights`` repeat over the sources by code point, null last. Targets sum up to
    ``share`` of all words; none is above ``most`` times its source, what is above is
    reshared by weight. That is one level for all sources below their bound, found by
    ordering the sources by bound per weight. The windows see one row per source.
    """
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    bounded = sums.withColumn("_weight", weight).withColumn(
        "_bound", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("_bound") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    from_here = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = (F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("_bound").over(before), F.lit(0.0)))
    level = left / F.sum("_weight").over(from_here)
    levelled = bounded.withColumn("_level", level).withColumn(
        "_below", F.col("_bound") / F.col("_weight") > F.col("_level"))
    final = F.max(F.when(F.col("_below"), F.col("_level"))).over(everything)
    return levelled.select("source", "source_size", F.when(
        F.col("_below"), final * F.col("_weight")).otherwise(F.col("_bound")).alias("target"))


def _ranked(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Certain copies, Pareto rank and its bucket; no rank where nothing is left to chance."""
    expected = F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0))
    u = uniform(F.col("_key"), seed)
    rank = F.when(F.col("_chance") > 0,
                  u / (1 - u) / (F.col("_chance") / (1 - F.col("_chance"))))
    return _by_source(sized, targets).withColumn("_whole", F.floor(expected)).withColumn(
        "_chance", expected - F.col("_whole")).withColumn("_rank", rank).withColumn(
        "_bucket", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS).cast("int"))


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Joins a table of one row per source, written before, so Spark knows its size."""
    renamed = per_source.withColumnRenamed("source", "_of")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def mixing_plan(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per source with its cut, from rows (_key, source, size) that can be read again."""
    targets = written(source_targets(sized, weights, share, most), "targets")
    ranked = _ranked(sized, targets, seed)
    buckets = ranked.groupBy("source", "_bucket").agg(
        F.sum("size").alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    of_source = W.partitionBy("source")
    so_far = of_source.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    chance_words = F.when(F.col("_bucket").isNotNull(), F.col("_words")).otherwise(0)
    summed = _by_source(buckets, targets).select(
        "source", "_bucket", F.sum(chance_words).over(so_far).alias("_until"),
        chance_words.alias("_here"),
        (F.col("target") - F.sum("_certain").over(of_source)).alias("_left"))
    crossed = written(summed.filter(
        F.col("_bucket").isNotNull() & (F.col("_until") >= F.col("_left"))).groupBy("source").agg(
        F.min("_bucket").alias("_cut_bucket"),
        F.min_by(F.col("_left") - F.col("_until") + F.col("_here"), "_bucket").alias("_left")),
        "crossings")
    inside = _by_source(ranked, crossed).filter(F.col("_bucket") == F.col("_cut_bucket")).groupBy(
        "source", "_rank", "_key").agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
    running = W.partitionBy("source").orderBy("_rank", "_key").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    cuts = inside.withColumn("_until", F.sum("_words").over(running)).filter(
        F.col("_until") - F.col("_words") / 2 <= F.col("_left")).groupBy("source").agg(
        F.max(F.struct("_rank", "_key")).alias("_cut"))
    with_bucket = targets.join(
        crossed.select(F.col("source").alias("_a"), "_cut_bucket"),
        F.col("source").eqNullSafe(F.col("_a")), "left").drop("_a")
    return written(with_bucket.join(
        cuts.withColumnRenamed("source", "_b"), F.col("source").eqNullSafe(F.col("_b")),
        "left").drop("_b"), "mixing-plan")


def mixed(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """Adds source_size, target, copies and taken to rows with _key, source and size.

    Each row is decided from its key and its source's cut alone, so no row is moved.
    """
    ranked = _ranked(sized, plan, seed)
    before = F.col("_cut_bucket").isNull() | (F.col("_bucket") < F.col("_cut_bucket"))
    at_cut = (F.col("_bucket") == F.col("_cut_bucket")) & (
        F.struct("_rank", "_key") <= F.col("_cut"))
    drawn = F.coalesce(F.col("_bucket").isNotNull() & (before | at_cut), F.lit(False))
    copies = F.col("_whole") + drawn.cast("long")
    return ranked.withColumn("copies", copies).withColumn(
        "taken", F.col("copies") * F.col("size")).select(*sized.columns, *ADDED[1:])


@apart(*INNER)
def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                most: float = 2.0, seed: int = 7, text: str = "text",
                key: str = "doc_id") -> DataFrame:
    """Every document with size, source_size, target, copies and taken (words with repeats)."""
    base = docs.drop(*ADDED).withColumn("size", word_count(F.col(text))).withColumn(
        "_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    sized = written(base.select("_key", "source", "size"), "sizes")
    plan = mixing_plan(sized, weights, share, most, seed)
    return mixed(base, plan, seed).drop("_key")


@apart("_copy", *ADDED)
def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    taken = mix_sources(docs, **options).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
                            ).select(*docs.columns)
