"""Exact duplicates with the frequent digests split off by Misra-Gries summaries.

A digest that many rows share would land in one task of a shuffle. Each task therefore
keeps a Misra-Gries summary of its digests; summed, the summaries name every digest of at
least ``share`` of the rows, and at most 2 / share digests in all. These are verified by a
partial count, and the verified winners are broadcast: all copies of frequent texts are
settled where they are read, also rows that tie for the place that stays. What remains is
shuffled, and no digest of it is frequent.

Defined cases: a null text is empty. Texts are equal if their SHA-256 is. Of equal texts
the largest doc_id stays, a null id only if there is no other; of repeated rows with that
id exactly one stays. Further columns are kept as they are. An empty table gives an empty
one. Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.names import apart
from tidemark.session import written

# A digest of this share of the rows counts as frequent; 2 / SHARE winners at most.
SHARE = 0.002


def misra_gries(digests: list, counters: dict, size: int) -> None:
    """Adds the digests to a summary of at most ``size`` counters, in place."""
    for digest in digests:
        if digest in counters:
            counters[digest] += 1
        elif len(counters) < size:
            counters[digest] = 1
        else:
            for key in [k for k, n in counters.items() if n == 1]:
                del counters[key]
            for key in counters:
                counters[key] -= 1


def _summaries(size: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            misra_gries(batch.column(0).to_pylist(), counters, size)
        yield pa.RecordBatch.from_pydict({
            "digest": pa.array([None, *counters], pa.string()),
            "n": pa.array([rows, *counters.values()], pa.int64())})
    return summarise


def frequent_digests(light: DataFrame, digest: str, share: float = SHARE) -> DataFrame:
    """Digests that may hold ``share`` of the rows: every one that does, 2 / share at most.

    A summary of 2 / share counters undercounts by at most share / 2 of the rows, so a
    frequent digest keeps a sum of share / 2 at least. The sums add up to at most all rows.
    """
    size = int(2 / share)
    sums = light.select(digest).mapInArrow(_summaries(size), "digest string, n long").groupBy(
        "digest").agg(F.sum("n").alias("n"))
    sums = written(sums, "summaries")
    rows = sums.filter("digest IS NULL").agg(F.sum("n")).first()[0] or 0
    return sums.filter(F.col("digest").isNotNull() & (F.col("n") * 2 >= rows * share)).select(
        F.col("digest").alias(digest))


@apart("_id", "_winner", "_size", "_place", "_first", "_metadata")
def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                     share: float = SHARE) -> DataFrame:
    """Every row with text_sha256, keep_id, group_size and kept added (replacing such columns)."""
    base = docs.drop("text_sha256", "keep_id", "group_size", "kept")
    tagged = base.withColumn("text_sha256", F.sha2(F.coalesce(text, F.lit("")), 256))
    light = written(tagged.select(F.col(key).alias("_id"), "text_sha256"), "digests")
    candidates = frequent_digests(light, "text_sha256", share)
    # Bounded by 2 / share rows, so the broadcast is of a proven size.
    winners = written(light.join(F.broadcast(candidates), "text_sha256").groupBy(
        "text_sha256").agg(F.max("_id").alias("_winner"), F.count(F.lit(1)).alias("_size")),
        "winners")
    split = tagged.join(F.broadcast(winners), "text_sha256", "left")
    frequent = F.col("_size").isNotNull()
    wins = F.col(key).eqNullSafe(F.col("_winner"))

    def settled(rows: DataFrame, kept: Column) -> DataFrame:
        return rows.select(*base.columns, "text_sha256", F.col("_winner").alias("keep_id"),
                           F.col("_size").alias("group_size"), kept.alias("kept"))

    losers = settled(split.filter(frequent & ~wins), F.lit(False))
    # Rows that repeat a winning id, or a group without ids, can be as many as the group. Once
    # written they have places, and the first place of each group stays: a partial minimum.
    tied = written(split.filter(frequent & wins), "tied").withColumn(
        "_place", F.struct("_metadata.file_path", "_metadata.row_index"))
    first = tied.groupBy("text_sha256").agg(F.min("_place").alias("_first"))
    # As many rows as there are winners.
    firsts = settled(tied.join(F.broadcast(first), "text_sha256"), F.col("_place") == F.col("_first"))
    group = W.partitionBy("text_sha256")
    rest = split.filter(~frequent).select(
        *base.columns, "text_sha256", F.max(key).over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col(key).desc_nulls_last())) == 1).alias("kept"))
    return rest.unionByName(losers).unionByName(firsts)


@apart("text_sha256", "keep_id", "group_size", "kept")
def without_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return exact_duplicates(docs, text, key).filter("kept").select(*docs.columns)
