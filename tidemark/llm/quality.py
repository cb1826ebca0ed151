"""Quality rules: counted text rules, then a likelihood ratio of hashed character n-grams.

Two multinomials over ``BUCKETS`` hashed n-grams (runs of ``GRAM`` code points) are counted:
one over the trusted rows, one over the whole raw corpus. The log of their ratio, smoothed by
one count a bucket, is a bucket's weight. A document's score is the mean weight of its
n-grams, so its length does not matter. Every document at or above one threshold is kept, the
rest is dropped: no random numbers take part. The threshold is the step of the score that
best parts the labelled rows that pass the counted rules (share of trusted rows kept less
share of other labelled rows kept; the lowest of equal ones).

Weights are whole numbers (millionths of a nat, rounded) and scores are whole numbers, so
sums do not depend on their order and reruns agree to the last row.

Counts cover all rows; what reaches the driver is one row a bucket and one a step of score.
The texts are shuffled once, to meet the labels of their ids.

Defined cases: a null text is empty and has no words. A text without n-grams scores 0. Of
repeated labels of an id the smallest counts; null labels and labels of unknown ids are not
used. Rows with a null id have no label. Repeated rows count as often as they stand. Without
trusted rows all weights are 0; without labelled rows of both kinds every row that passes the
rules is kept. The text itself is not returned; all further columns are, and columns named as
the added ones are replaced. An empty table gives an empty one. Long texts are read whole, in
stretches of ``STRIDE`` code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.names import spare
from tidemark.session import written

# The n-grams: code points in a row, and a polynomial of them modulo a prime.
GRAM, BASE, BUCKETS = 4, 7919, 65_521
# Weights and scores are in millionths; thresholds in steps of so many of them.
UNIT, STEP = 1_000_000, 1_000
# Code points hashed at a time.
STRIDE = 1 << 20
FEWEST_WORDS, REPEATED_SHARE = 50, 50
BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
         "n_repeat_words": "long", "base_failed": "boolean", "score": "long"}


def grams(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, a stretch at a time."""
    for start in range(0, max(1, len(text) - GRAM + 1), STRIDE):
        part = text[start:start + STRIDE + GRAM - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = len(codes) - GRAM + 1
        if size > 0:
            hashed = codes[:size]
            for n in range(1, GRAM):
                hashed = hashed * BASE + codes[n:n + size]
            yield hashed % BUCKETS


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that the list holds twice or more."""
    if len(words) < 4:
        return 0
    number = {w: n for n, w in enumerate(dict.fromkeys(words))}
    if len(number) > len(words) - 2:  # too few repeats for any window
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True,
                                return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(len(words), bool)
    for n in range(3):
        covered[n:len(words) - 2 + n] |= twice
    return int(covered.sum())


def rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """The counted rules of one text: the values of ``ADDED`` up to base_failed."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at ASCII blanks only
    dense = data.translate(None, BLANKS)
    word_chars = len(text) - (len(data) - len(dense))
    symbols = len(dense) - len(dense.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeats = repeated_words(words)
    failed = len(words) < FEWEST_WORDS or 100 * repeats > REPEATED_SHARE * len(words)
    return (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeats, failed)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task: of all its texts and of the trusted ones."""
    counts = np.zeros((2, BUCKETS), np.int64)  # of the trusted texts in the second row
    held: tuple[list, list] = ([], [])

    def add(least: int) -> None:
        for kind, found in enumerate(held):
            if sum(map(len, found)) > least:
                counts[kind] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                found.clear()

    for batch in batches:
        for text, trust in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held[bool(trust)].extend(grams(text.as_py() or ""))
            add(STRIDE)
    add(0)
    raw = counts.sum(axis=0)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": at, "n": raw[at], "trusted": counts[1][at]})


def weights(docs: DataFrame, labels: DataFrame, key: str, text: str) -> np.ndarray:
    """The weight of every bucket from the counts over all rows."""
    known = labels.filter("trusted").select(F.col("_label_key").alias("_key"),
                                            F.lit(True).alias("_trusted"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # Ids that are null meet no label and need not be dealt out by id.
    # The same plan at every size: a hash table of the labels of a partition, texts unsorted.
    joined = texts.filter("_key IS NOT NULL").join(
        known.hint("shuffle_hash"), "_key", "left").select(
        "_text", "_trusted").unionByName(
        texts.filter("_key IS NULL").select("_text", F.lit(None).cast("boolean").alias("_trusted")))
    counted = joined.mapInArrow(_count, "bucket long, n long, trusted long").groupBy(
        "bucket").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))
    counts = np.zeros((2, BUCKETS))
    for row in counted.collect():  # at most one row a bucket
        counts[:, row["bucket"]] = row["n"], row["trusted"]
    if not counts[1].any():
        return np.zeros(BUCKETS, np.int64)
    logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS))
    return np.round((logs[1] - logs[0]) * UNIT).astype(np.int64)


def quality_measures(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Every row without its text, with the columns of ``ADDED``.

    ``labels``: ``_label_key`` (each once) and ``trusted``.
    """
    base = docs.drop(*(c for c in ADDED if c not in (key, text)))
    shared = docs.sparkSession.sparkContext.broadcast(weights(docs, labels, key, text))
    at = base.columns.index(text)
    rest = [n for n in range(len(base.columns)) if n != at]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            rows = []
            for cell in batch.column(at):
                whole = cell.as_py() or ""
                total = count = 0
                for found in grams(whole):
                    total += int(weight[found].sum())
                    count += len(found)
                rows.append((*rules(whole), total // count if count else 0))
            columns = zip(*rows, strict=True) if rows else [()] * len(ADDED)
            added = [pa.array(c, pa.bool_() if kind == "boolean" else pa.int64())
                     for c, kind in zip(columns, ADDED.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), *added],
                [*(batch.schema.names[n] for n in rest), *ADDED])

    added = T._parse_datatype_string(", ".join(f"{c} {kind}" for c, kind in ADDED.items()))
    schema = T.StructType([*(base.schema.fields[n] for n in rest), *added.fields])
    return base.mapInArrow(measure, schema)


def threshold(steps: list[tuple[int, bool, int]]) -> int | None:
    """The lowest step that best parts trusted from other rows; None without both kinds.

    ``steps``: step of the score, whether trusted, rows.
    """
    total = {kind: sum(n for _, k, n in steps if k == kind) for kind in (True, False)}
    if not (total[True] and total[False]):
        return None
    best, lead, above = None, -1.0, {True: total[True], False: total[False]}
    by_step: dict[int, dict[bool, int]] = {}
    for step, kind, n in steps:
        by_step.setdefault(step, {True: 0, False: 0})[kind] += n
    for step in sorted(by_step):
        now = above[True] / total[True] - above[False] / total[False]
        if now > lead:
            best, lead = step, now
        for kind in above:
            above[kind] -= by_step[step][kind]
    return best


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Adds the columns of ``ADDED`` and kept to every row, without its text.

    ``labels`` has ``key`` and quality (1: trusted, 0: not).
    """
    known = labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(
        F.col(key).alias("_label_key")).agg((F.min("quality") == 1).alias("trusted"))
    measured = written(quality_measures(docs.drop(*({"kept"} - {key, text})), known, key, text),
                       "quality")
    label, = spare(measured.columns, "_trusted")
    light = measured.filter(~F.col("base_failed") & F.col(key).isNotNull()).select(
        F.col(key).alias("_label_key"), F.floor(F.col("score") / STEP).alias("step"))
    steps = light.join(known.withColumnRenamed("trusted", label), "_label_key").groupBy(
        "step", label).count()
    # One row a step and kind: weights are bounded, so the steps are.
    least = threshold([tuple(r) for r in steps.collect()])
    verdict = F.lit(True) if least is None else F.floor(F.col("score") / STEP) >= least
    return measured.withColumn("kept", ~F.col("base_failed") & verdict)
