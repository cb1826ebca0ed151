"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on the driver from a bounded sample: each node parts its sample at the
median along the line between two of its vectors. Every vector is indexed in every tree.
A query walks all trees through one priority queue, ordered by the distance to the planes
crossed, until the leaves it has opened hold a given share of the rows (``visit``). That
share is measured: the least with which queries of the sample find ``RECALL`` of their
nearest in the sample, so data with structure opens little and data without it much.

The opened leaves are joined with the indexed vectors leaf by leaf, and what is nearest
there, with all that single precision cannot tell from it, is ranked again exactly, in
double precision, on the original vectors. A tight group of vectors is therefore ranked
whole.

Equal vectors are folded before, each with the few smallest ids that any result can name,
so a vector that many rows share is one row. Leaves are sampled evenly, so they hold about
equal shares of the distinct vectors. A leaf grows with the table, so its vectors and its
queries are dealt into parts of about ``PART_BYTES``, and every part of the one meets every
part of the other in a group of its own; in it, both are compared in blocks.

Defined cases: rows without id or with a vector that is null, zero, of another length than
most of the sample, or holds null or non-finite components, take no part. Repeated rows
count once. Ties go to the smaller id. Fewer candidates than asked are all returned. Columns
beside id and vector are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import written

# Bound of the sample that the trees are fitted on, and its rows in a leaf.
SAMPLE_ROWS, LEAF_SAMPLE = 16_384, 32
TREES, SEED = 8, 11
# Share of the nearest that queries of the sample have to find, and how many of them are asked.
RECALL, PROBES = 0.97, 192
# Vectors of one side of a group, in bytes of single precision, and the sides of a block.
PART_BYTES = 32 << 20
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
# Queries that walk the trees in one task, and at once.
WALKS, WALK_BLOCK = 128, 64


class Forest:
    """Trees as nested tuples (plane, left, right), planes and leaves as numbers."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.shares: list[list[float]] = []
        planes: list[np.ndarray] = []
        middles: list[float] = []
        self.trees = [self._tree(sample, rng, leaf_rows, planes, middles) for _ in range(trees)]
        self.planes = np.array(planes).reshape(len(planes), sample.shape[1])
        self.middles = np.array(middles)
        lengths = np.linalg.norm(self.planes, axis=1)
        self.lengths = np.where(lengths > 0, lengths, 1.0)

    def _tree(self, sample: np.ndarray, rng: np.random.Generator, leaf_rows: int,
              planes: list[np.ndarray], middles: list[float]):
        shares: list[float] = []
        self.shares.append(shares)

        def grow(rows: np.ndarray):
            if len(rows) >= 2 * leaf_rows:
                one, two = sample[rng.choice(rows, 2, replace=False)]
                plane = one - two
                along = sample[rows] @ plane
                middle = float(np.median(along))
                right = along > middle
                if right.any() and not right.all():
                    planes.append(plane)
                    middles.append(middle)
                    return len(planes) - 1, grow(rows[~right]), grow(rows[right])
            shares.append(len(rows) / len(sample))
            return len(shares) - 1

        return grow(np.arange(len(sample)))

    def leaves(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int32)

        def place(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                plane, left, right = node
                beyond = vectors[rows] @ self.planes[plane] > self.middles[plane]
                place(left, rows[~beyond])
                place(right, rows[beyond])

        place(self.trees[tree], np.arange(len(vectors)))
        return out

    def sides(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distance of each vector to each plane."""
        return (vectors @ self.planes.T - self.middles) / self.lengths

    def search(self, sides: list[float], visit: float) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs opened for a query, nearest first, through one queue."""
        queue: list = [(0.0, i, i, node) for i, node in enumerate(self.trees)]
        count, seen, opened = len(queue), 0.0, []
        while queue and seen < visit:
            far, _, tree, node = heapq.heappop(queue)
            while isinstance(node, tuple):
                plane, left, right = node
                side = sides[plane]
                node, other = (right, left) if side > 0 else (left, right)
                count += 1
                heapq.heappush(queue, (max(far, abs(side)), count, tree, other))
            opened.append((tree, node))
            seen += self.shares[tree][node]
        return opened


def share_to_visit(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL,
                   probes: int = PROBES) -> float:
    """The least ``visit`` with which evenly drawn queries of the sample find ``recall`` of
    their k nearest others in the sample."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return float(len(forest.trees))
    drawn = np.unique(np.linspace(0, len(sample) - 1, probes).astype(int))
    cosines = sample[drawn] @ sample.T
    cosines[np.arange(len(drawn)), drawn] = -np.inf
    nearest_ones = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    homes = np.array([forest.leaves(sample, tree) for tree in range(len(forest.trees))])
    sides = forest.sides(sample[drawn])
    needed = []
    for row, wanted in enumerate(nearest_ones):
        opened = forest.search(sides[row].tolist(), math.inf)
        # What has been seen before a leaf is opened: it is opened with any more than that.
        shares = np.array([forest.shares[tree][leaf] for tree, leaf in opened])
        before = dict(zip(opened, np.cumsum(shares) - shares, strict=True))
        needed += [min(before[tree, int(leaf)] for tree, leaf in enumerate(homes[:, one]))
                   for one in wanted]
    needed.sort()
    return float(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1e-9


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    values = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(
        values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    ) & F.exists(values, lambda x: x != 0)
    return rows.filter(good).select(F.col(key).alias("id"), values.alias("vector"))


def _fold(rows: DataFrame, keep: int) -> DataFrame:
    """Each distinct vector once: vid (its smallest id) and its ``keep`` smallest ids."""
    order = W.partitionBy("vector").orderBy("id")
    return rows.distinct().withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= keep).groupBy("vector").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("vid"), "ids", "vector")


def _units(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    # Scaled before squaring, so neither large nor small components overflow.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _packed(units: np.ndarray) -> pa.Array:
    """Vectors as binary, a row each; single precision is enough to find candidates."""
    data, width = np.ascontiguousarray(units, "<f4").tobytes(), 4 * units.shape[1]
    return pa.array([data[i:i + width] for i in range(0, len(data), width)], pa.binary())


def _index(forest: Forest):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(batch, 1)
            packed = _packed(units)
            for tree in range(len(forest.trees)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(units), tree, np.int32)),
                     pa.array(forest.leaves(units, tree)), batch.column(0), packed],
                    ["tree", "leaf", "vid", "unit"])
    return place


def _open(forest: Forest, visit: float):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(batch, 1)
            packed = _packed(units)
            for row in range(len(units)):
                if row % WALK_BLOCK == 0:
                    sides = forest.sides(units[row:row + WALK_BLOCK])
                opened = forest.search(sides[row % WALK_BLOCK].tolist(), visit)
                trees, leaves = (pa.array(c, pa.int32()) for c in zip(*opened, strict=True))
                at = pa.array(np.full(len(opened), row))
                yield pa.RecordBatch.from_arrays(
                    [trees, leaves, batch.column(0).take(at), packed.take(at)],
                    ["tree", "leaf", "qid", "unit"])
    return walk


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1)


def rounding(width: int) -> float:
    """What two single-precision cosines of this width can differ by in excess of the exact ones.

    Each is off by the rounding of both vectors and of ``width`` sums at most.
    """
    return 2 * (width + 4) * float(np.finfo(np.float32).eps)


def _tops(cosines: np.ndarray, count: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each row holds its ``count`` largest and all within ``error`` of the last of them."""
    place = min(count, cosines.shape[1]) - 1
    last = -np.partition(-cosines, place, axis=1)[:, place]
    return np.nonzero(cosines >= (last - error)[:, None])


def _nearest(count: int, error: float):
    """Joins a part of a leaf's vectors with a part of the queries that opened it.

    The nearest of each query are the first ``count`` and whatever single precision cannot
    tell from them. Blocks of vectors give theirs, and the best of these stay.
    """
    def join(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        if rows.num_rows and queries.num_rows:
            vids, units = rows["vid"].to_numpy(), _stack(rows["unit"])
            for start in range(0, queries.num_rows, QUERY_BLOCK):
                part = queries.slice(start, QUERY_BLOCK)
                asked, qids = _stack(part["unit"]), part["qid"].to_numpy()
                kept: list = [[], [], []]
                for first in range(0, len(vids), ROW_BLOCK):
                    cosines = (asked @ units[first:first + ROW_BLOCK].T).astype(np.float64)
                    at, which = _tops(cosines, count, error)
                    for column, values in zip(kept, (at, first + which, cosines[at, which]),
                                              strict=True):
                        column.append(values)
                at, which, near = map(np.concatenate, kept)
                if len(vids) > ROW_BLOCK:
                    order = np.lexsort((-near, at))
                    at, which, near = at[order], which[order], near[order]
                    begins = np.searchsorted(at, np.arange(len(qids) + 1))
                    last = near[np.minimum(begins[:-1] + count, begins[1:]) - 1]
                    good = near >= last[at] - error
                    at, which, near = at[good], which[good], near[good]
                found[0].append(qids[at])
                found[1].append(vids[which])
                found[2].append(near)
        columns = [np.concatenate(f) if f else np.zeros(0, t)
                   for f, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("qid", "vid", "near"), columns, strict=True)))
    return join


def _dealt(own: DataFrame, key: str, parts: int, others: int, mine: str, other: str) -> DataFrame:
    """Each row in one of its side's parts, once for every part of the other side."""
    return own.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _dot(one: Column, two: Column) -> Column:
    return F.aggregate(F.zip_with(one, two, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cosine(one: Column, two: Column) -> Column:
    """Cosine of two vectors of doubles."""
    return _dot(one, two) / (F.sqrt(_dot(one, one)) * F.sqrt(_dot(two, two)))


def _sample(folded: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` distinct vectors, by a hash of the vector, as unit vectors."""
    total = folded.count()
    if not total:
        return np.zeros((0, 0))
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    drawn = folded.filter(place <= int((1 << 30) * min(1.0, rows / total))).limit(rows).select(
        "vector").toArrow()["vector"].to_pylist()
    lengths = [len(v) for v in drawn]
    most = max(set(lengths), key=lambda n: (lengths.count(n), n))
    vectors = np.array([v for v in drawn if len(v) == most])
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return units[np.lexsort(units.T)]


def nearest(rows: DataFrame, queries: Column, k: int = 5, key: str = "vec_id",
            vector: str = "embedding", trees: int = TREES, visit: float | None = None,
            sample_rows: int = SAMPLE_ROWS, leaf_sample: int = LEAF_SAMPLE,
            seed: int = SEED, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others of every row for which ``queries``
    (a condition on the id, here named id) holds.

    ``visit`` is the share of all rows that the leaves opened for a query hold, summed over
    the trees; without it, it is measured on the sample.
    """
    spark = rows.sparkSession
    valid = usable(rows, key, vector)
    folded = written(_fold(valid, k + 1), "vectors")
    sample = _sample(folded, sample_rows)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    folded = folded.filter(F.size("vector") == sample.shape[1])
    forest = Forest(sample, trees, leaf_sample, seed)
    asked = written(valid.filter(queries).distinct().join(
        folded.select("vid", "vector"), "vector").select("id", F.col("vid").alias("qid"),
                                                         "vector"), "queries")
    share = share_to_visit(forest, sample, k) if visit is None else visit
    # The walk of a query is long and its row short: tasks by number of queries, not by size.
    walks = asked.select("qid", "vector").distinct().repartition(max(1, min(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // WALKS))), "qid")
    indexed = folded.select("vid", "vector").mapInArrow(
        _index(forest), "tree int, leaf int, vid long, unit binary")
    opened = walks.mapInArrow(
        _open(forest, share), "tree int, leaf int, qid long, unit binary")
    error = rounding(sample.shape[1])
    # A leaf holds about its share of the vectors, and about visit / trees of all queries open it.
    largest = max(max(shares) for shares in forest.shares)
    in_part = max(1, part_bytes // (4 * sample.shape[1]))
    row_parts = math.ceil(folded.count() * largest / in_part) or 1
    query_parts = math.ceil(asked.count() * min(1.0, share / trees) / in_part) or 1
    group = ["tree", "leaf", "_row_part", "_query_part"]
    found = _dealt(indexed, "vid", row_parts, query_parts, "_row_part", "_query_part").groupBy(
        *group).cogroup(_dealt(opened, "qid", query_parts, row_parts, "_query_part", "_row_part"
                               ).groupBy(*group)).applyInArrow(
        _nearest(k + 1, error), "qid long, vid long, near double")
    # Rounding in the leaves must not push out one of the nearest: all within its error of the
    # last place are ranked again.
    order = W.partitionBy("qid").orderBy(F.desc("near"), "vid")
    near = written(found.groupBy("qid", "vid").agg(F.max("near").alias("near")), "candidates")
    last = near.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= k + 1).groupBy("qid").agg(F.min("near").alias("_last"))
    best = near.join(last, "qid").filter(F.col("near") >= F.col("_last") - error).select(
        "qid", "vid")
    by_vector = asked.select("qid", F.col("vector").alias("_query")).distinct()
    scored = best.join(by_vector, "qid").join(folded, "vid").select(
        "qid", F.explode("ids").alias("vec_id"),
        cosine(F.col("_query"), F.col("vector")).alias("score"))
    few = written(scored.withColumn("_n", F.row_number().over(
        W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1
        ).groupBy("qid").agg(F.collect_list(F.struct("score", "vec_id")).alias("found")), "found")
    each = asked.select("id", "qid").join(few, "qid").select(
        F.col("id").alias("query_id"), F.slice(F.filter(
            F.array_sort("found", lambda a, b: F.when(a["score"] > b["score"], -1).when(
                a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).otherwise(1)),
            lambda f: f["vec_id"] != F.col("id")), 1, k).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("_place", "_hit")).select(
        "query_id", (F.col("_place") + 1).alias("rank"), "_hit.vec_id", "_hit.score")
