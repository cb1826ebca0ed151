"""Near duplicates by SimHash: segment popcounts, a grid join, exact verification.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits, which
fit into 64 bits again. The Manhattan distance of two such vectors is never above the
Hamming distance of the fingerprints, so fingerprints that differ in at most two bits have
vectors at distance 2 or less, and such vectors share a grid point within distance 1 of
both. Each distinct fingerprint therefore goes to its own point and to the neighbours one
step away (49 on average), points are joined on equality, each pair is kept at one point
only, and the Hamming distance decides.

Copies share a fingerprint and are folded before the join, so groups of copies cost one
row. The cells are fine: a cell gathers fingerprints that agree in 31 of 32 counts.

Defined cases: a null or wordless text has the fingerprint zero and is linked like any
other; fewer words than a shingle form one shingle. Repeated rows are copies. The id of a
component is the smallest non-null doc_id in it (null if all are). Further columns are kept;
columns named fingerprint or component_id are replaced. Long texts are hashed in blocks of
words, whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.names import spare
from tidemark.session import written

SHINGLE, SEED, DISTANCE = 3, 42, 2
SEGMENTS = 32
BLOCK = 65536
LOW_BITS = 0x5555555555555555


def _votes(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How often each bit is set in the shingles' hashes, and the number of shingles."""
    votes, total = np.zeros(64, np.int64), max(len(words) - SHINGLE + 1, 1)
    for start in range(0, total, BLOCK):
        part = words[start:start + BLOCK + SHINGLE - 1]
        line = b" ".join(part)
        begins = np.zeros(len(part) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1, out=begins[1:])
        count = max(len(part) - SHINGLE + 1, 1)
        firsts, lasts = begins[:count], begins[len(begins) - count:] - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED)
                              for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)),
                             np.uint64, count)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(count, 8), axis=1,
                             bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return votes, total


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    votes, total = _votes(words)
    set_bits = np.packbits(votes * 2 > total, bitorder="little")
    return int(set_bits.view("<i8")[0])


def _fingerprints(at: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t.as_py()) for t in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())],
                                             [*names, "_print"])
    return add


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _print) per row; only these two columns reach the Python worker."""
    light = docs.select(key, text)
    kind = light.schema[key].dataType.simpleString()
    return light.mapInArrow(_fingerprints(1), f"`{key}` {kind}, _print long")


def bit_counts(fingerprint: Column) -> Column:
    """The 32 counts of two-bit segments, packed into a long."""
    upper = F.shiftrightunsigned(fingerprint, 1)
    ones = fingerprint.bitwiseXOR(upper).bitwiseAND(F.lit(LOW_BITS))
    twos = fingerprint.bitwiseAND(upper).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(twos, 1).bitwiseOR(ones)


def _shifted(number: Column, places: Column, left: bool = False) -> Column:
    name = "shiftleft" if left else "shiftrightunsigned"
    return F.call_function(name, number, places.cast("int"))


def _points(counts: Column) -> Column:
    """The packed vectors at Manhattan distance 1 at most: one segment one up or down."""
    def steps(segment: Column) -> Column:
        here = _shifted(counts, 2 * segment).bitwiseAND(F.lit(3))

        def with_count(count: Column) -> Column:
            return counts.bitwiseXOR(_shifted(here.bitwiseXOR(count), 2 * segment, left=True))

        return F.array(F.when(here < 2, with_count(here + 1)),
                       F.when(here > 0, with_count(here - 1)))

    moved = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), steps))
    return F.concat(F.array(counts), F.filter(moved, lambda point: point.isNotNull()))


def links_of(distinct: DataFrame) -> DataFrame:
    """(node, other), node < other, for every two fingerprints at most two bits apart.

    ``distinct`` has each fingerprint once, as _print. A pair with equal vectors is taken
    at its own point, one a step apart at the point of its smaller fingerprint, and one
    two steps apart at each point between (two at most).

    Fingerprints are few bytes and their points many rows, so they are spread by number
    first. The join's condition holds no part on one side alone: both sides are then the
    same exchange, which is made once. The join is a merge by hint: Spark sizes the points
    by the fingerprints they come from, and would broadcast fifty times what it expects.
    """
    spread = distinct.repartition(
        int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_print")
    points = spread.select(
        "_print", F.explode(_points(bit_counts(F.col("_print")))).alias("_point"))
    one, two = points.alias("one"), points.alias("two")
    a, b, point = F.col("one._print"), F.col("two._print"), F.col("one._point")
    own = bit_counts(a) == point
    between = (bit_counts(b) != point) & (bit_counts(a) != bit_counts(b))
    return one.join(two.hint("merge"), (point == F.col("two._point")) & (a < b) & (own | between) & (
        F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)).select(
        a.alias("node"), b.alias("other")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _print, fingerprint, component_id) for every row."""
    prints = written(fingerprints(docs, key, text), "fingerprints")
    folded = written(prints.groupBy("_print").agg(F.min(key).alias("_least")), "distinct-prints")
    roots = written(connected(links_of(folded.select("_print"))), "roots")
    linked = roots.join(folded, F.col("node") == F.col("_print")).select(
        "node", "root", "_least")
    least = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_linked = linked.join(least, "root").select(
        F.col("node").alias("_print"), "component_id")
    labels = written(folded.join(of_linked, "_print", "left").select(
        "_print", F.coalesce("component_id", "_least").alias("component_id")), "labels")
    return prints.join(labels, "_print").select(
        key, "_print", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        "component_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text"
                            ) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest id.

    Rows without id come after all others, and of rows that share their id (or have none)
    that with the smaller hash of its text comes first. Rows that share id and text are one
    document and stay or go together.
    """
    me, = spare([*docs.columns, "component_id", "fingerprint", "_print"], "_me")
    named = docs.withColumn(me, F.struct(
        F.col(key).isNull().alias("last"), F.col(key).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash")))
    losers = written(near_duplicates(named, me, text).filter(
        F.col(me) != F.col("component_id")).select(me).distinct(), "near-copies")
    return named.join(losers, me, "left_anti").select(*docs.columns)
