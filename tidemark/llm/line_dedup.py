"""Repeated passages of lines, found by shared rare line hashes and cut after a patience diff.

A line is rare if it is long. Shorter ones are hashed together with the lines after them,
and with those before them, until they hold ``min_words`` words: any passage of that size
that two documents share holds such a run around each of its lines. Every run hash points
to the earliest document that holds it, so a passage of n documents makes n - 1 links and
not all pairs, and no line is too common. Linked documents are aligned by a patience diff:
lines that are unique on both sides and in the same order are anchors, equal lines around
them follow, and the stretches between are aligned in turn. Runs of aligned lines of
``min_words`` words or more are cut from the later document, and so are its runs whose hash
the earlier one has but the alignment has not: passages that repeat or stand in another order.

Later is the larger id, null first; rows with equal ids go by a hash of their text, and
rows that are equal in both are one document, whose cuts all of them get. A document of
one line is a line. Lines are compared by 64-bit hashes; a passage would take several
chance agreements in a row.

Defined cases: a null text stays null and an empty one empty; blank lines are never
evidence, but go if they stand inside a cut run. Further columns are kept, columns named
as the added ones are replaced. Long texts are read whole. An empty table gives an empty
one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import apart
from tidemark.session import written

MIN_WORDS = 50
# Bytes of text whose lines a worker holds at once.
PIECE = 1 << 20
ADDED = ("deduped", "removed_lines", "removed_words")
_BLANKS = r"[^\x20\x09-\x0D]+"


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first places, whose second rise."""
    tops: list[int] = []
    at_top: list[int] = []
    before: list[int] = []
    for n, (_, place) in enumerate(pairs):
        pile = bisect_left(tops, place)
        before.append(at_top[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(place)
            at_top.append(n)
        else:
            tops[pile], at_top[pile] = place, n
    out, n = [], at_top[-1] if at_top else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, rising on both sides."""
    matches: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matches.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matches.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        places = {line: n for n, line in enumerate(b[b0:b1], b0) if in_b[line] == 1}
        anchors = _increasing([(n, places[line]) for n, line in enumerate(a[a0:a1], a0)
                               if in_a[line] == 1 and line in places])
        if anchors:
            edges = [*anchors, (a1, b1)]
            waiting.append((a0, anchors[0][0], b0, anchors[0][1]))
            # A stretch begins with its anchor, which then matches as equal lines do.
            waiting += [(n, after_n, m, after_m) for (n, m), (after_n, after_m)
                        in zip(edges, edges[1:], strict=False)]
    return sorted(matches)


def common_runs(a: np.ndarray, b: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(first line, last line, words) of what the later document b has in common.

    Rows are (rank among the lines that are not blank, line number, hash, words).
    """
    runs: list[tuple[int, int, int]] = []
    last = (-2, -2)
    for n, m in patience(a["hash"].tolist(), b["hash"].tolist()):
        here = (int(a["rank"][n]), int(b["rank"][m]))
        line, words = int(b["no"][m]), int(b["words"][m])
        if here == (last[0] + 1, last[1] + 1):
            runs[-1] = (runs[-1][0], line, runs[-1][2] + words)
        else:
            runs.append((line, line, words))
        last = here
    found = [run for run in runs if run[2] >= min_words]
    return found + _left_over(a, b, found, min_words)


def _left_over(a: np.ndarray, b: np.ndarray, found: list[tuple[int, int, int]], min_words: int
               ) -> list[tuple[int, int, int]]:
    """Runs that b shares with a but the alignment does not hold: repeated or in another order."""
    aligned = np.zeros(len(b), bool)
    for first, last, _ in found:
        aligned |= (b["no"] >= first) & (b["no"] <= last)
    known = np.isin(b["hash"], a["hash"])
    # Windows of known lines alone that are not aligned throughout.
    strange, held = (np.concatenate([[0], np.cumsum(c)]) for c in (~known, aligned))
    waiting = sorted((n, m) for n, m in run_windows(b["words"], min_words)
                     if strange[m] == strange[n] and held[m] - held[n] < m - n)
    if not waiting:
        return []
    there, here = (np.ascontiguousarray(side["hash"], np.int64) for side in (a, b))
    in_a = run_hashes(there, a["words"], min_words)
    spans: list[list[int]] = []
    for n, m in waiting:
        if _digest(here[n:m]) in in_a:
            if spans and n < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], m)
            else:
                spans.append([n, m])
    return [(int(b["no"][n]), int(b["no"][m - 1]), int(b["words"][n:m].sum())) for n, m in spans]


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of line structs of a column as arrays."""
    flat = column.flatten()
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    table = np.rec.fromarrays(list(fields.values()), names=list(fields))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [table[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []


def _align(min_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, *run) for n, (a, b) in enumerate(zip(
                _rows(batch.column(1)), _rows(batch.column(2)), strict=True))
                for run in common_runs(a, b, min_words)]
            at, first, last, words = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(first, pa.int32()),
                 pa.array(last, pa.int32()), pa.array(words, pa.int32())],
                ["doc", "first", "last", "words"])
    return cut


def _document(key: str, text: str) -> Column:
    return F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("print"))


def run_windows(words: np.ndarray, min_words: int) -> set[tuple[int, int]]:
    """(begin, end) of the shortest runs of ``min_words`` words that begin, or end, at a line."""
    until = np.cumsum(words)
    before = until - words
    size = len(words)
    ends = np.searchsorted(until, before + min_words)
    begins = np.searchsorted(before, until - min_words, side="right") - 1
    runs = {(n, int(e) + 1) for n, e in enumerate(ends) if e < size}
    return runs | {(int(b), n + 1) for n, b in enumerate(begins) if b >= 0}


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def run_hashes(hashes: np.ndarray, words: np.ndarray, min_words: int) -> set[int]:
    """Hashes of the runs of ``run_windows``."""
    return {_digest(hashes[a:b]) for a, b in run_windows(words, min_words)}


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``PIECE`` bytes of text each; a longer text is alone or last."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def _full_lines(text: str | None) -> np.ndarray:
    """(rank, line number, hash, words) of the lines that are not blank."""
    found = [(n, xxhash.xxh64_intdigest(line) - (1 << 63), len(line.split()))
             for n, line in enumerate((text or "").encode("utf-8").split(b"\n"))]
    full = np.array([f for f in found if f[2]], np.int64).reshape(-1, 3)
    return np.column_stack([np.arange(len(full)), full])


def _sequences(min_words: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch may hold thousands of long texts: it is given on in pieces of bounded bytes.
        for batch in batches:
            for begin, end in _stretches(batch.column(1)):
                part = batch.slice(begin, end - begin)
                tables = [_full_lines(text) for text in part.column(1).to_pylist()]
                runs = [list(run_hashes(np.ascontiguousarray(t[:, 2]), t[:, 3], min_words))
                        for t in tables]
                rank, no, hashes, words = np.concatenate([np.empty((0, 4), np.int64), *tables]).T
                lines = pa.StructArray.from_arrays(
                    [pa.array(rank, pa.int32()), pa.array(no, pa.int32()), pa.array(hashes, pa.int64()),
                     pa.array(words, pa.int32())], ["rank", "no", "hash", "words"])
                offsets = np.cumsum([0, *map(len, tables)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines),
                     pa.array(runs, pa.list_(pa.int64()))], ["doc", "lines", "runs"])
    return split


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, first, last, words): runs of lines that an earlier document has as well."""
    light = docs.select(_document(key, text).alias("doc"), text)
    doc_type = light.schema["doc"].dataType.simpleString()
    read = written(light.mapInArrow(
        _sequences(min_words),
        f"doc {doc_type}, lines array<struct<rank: int, no: int, hash: long, words: int>>, "
        "runs array<long>"), "line-sequences")
    runs = read.select("doc", F.explode("runs").alias("run"))
    shared = runs.groupBy("run").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest")
                                     ).filter("earliest != latest").drop("latest")
    pairs = written(runs.join(shared, "run").filter("doc != earliest").select(
        "earliest", "doc").distinct(), "overlapping")
    linked = pairs.select("doc").union(pairs.select("earliest")).distinct()
    lines = written(read.join(linked, "doc", "left_semi").groupBy("doc").agg(
        F.first("lines").alias("lines")), "linked-lines")
    both = pairs.join(lines.select(F.col("doc").alias("earliest"), F.col("lines").alias("a")),
                      "earliest").join(lines.withColumnRenamed("lines", "b"), "doc")
    return both.select("doc", "a", "b").mapInArrow(
        _align(min_words), f"doc {doc_type}, first int, last int, words int")


@apart("_runs", "_run_doc")
def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
               min_words: int = MIN_WORDS) -> DataFrame:
    """Adds deduped (the text without repeated runs), removed_lines and removed_words."""
    base = docs.drop(*ADDED)
    runs = repeated_runs(base.select(key, text), key, text, min_words)
    gathered = written(runs.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias(
        "_runs")), "runs").withColumnRenamed("doc", "_run_doc")
    here = _document(key, text)
    lines = F.split(text, "\n")

    def goes(n: Column) -> Column:
        return F.exists("_runs", lambda run: (run["first"] <= n) & (n <= run["last"]))

    # Sorted and merged at every size: a broadcast while the runs are few would only change
    # the plan once they are not.
    joined = base.join(gathered.hint("merge"), (here["id"].eqNullSafe(F.col("_run_doc.id")))
                       & (here["print"] == F.col("_run_doc.print")), "left")
    kept = F.filter(lines, lambda _, n: ~goes(n))
    cut = F.filter(lines, lambda _, n: goes(n))
    some = F.col("_runs").isNotNull()
    return joined.select(
        *base.columns, F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(
            "deduped"),
        F.when(some, F.size(cut)).otherwise(0).cast("long").alias("removed_lines"),
        F.when(some, F.regexp_count(F.array_join(cut, "\n"), F.lit(_BLANKS))).otherwise(0).cast(
            "long").alias("removed_words"))
