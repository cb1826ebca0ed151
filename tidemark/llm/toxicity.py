"""Toxicity by compression distance: which of two dictionaries makes a window shorter.

Two zstandard dictionaries are built from labelled rows: one holds ordinary text, the other
the same text before passages that set toxic rows apart (words whose beginnings, or which
themselves, stand in far more toxic rows than chance gives). The ordinary text is the most
frequent words of whole ordinary rows. Every window of a text is
compressed with both. The bytes saved by the toxic dictionary are its margin, and how
toxic a given set of margins is was calibrated on rows that the dictionaries have not seen,
with both labels weighted alike: a score of 0.5 is where a row is as likely of either kind
before anything is known of their shares.
A window is one word or ``LONGEST`` letters of it, written twice, between a line that both dictionaries end with and a
closing mark: so even the shortest window is compressed at all, and its lengths differ by
about the letters that only one dictionary knows.

Fitting takes a bounded sample of the labelled rows (``fit_rows`` of each label) to the
driver; scoring covers every window of every row.

Defined cases: a null or empty text has no windows and gets the score of that case. Labels
that are null or of unknown rows are not used; of repeated labels the larger counts. Long
words are windows of ``LONGEST`` characters each. Rows are scored one by one, so ties and
repeated rows change nothing; further columns are kept, and columns named as the added ones
are replaced. Without labels of both kinds every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import apart

# Labelled rows of each kind that the dictionaries are built from and calibrated on.
FIT_ROWS = 2500
# Content beyond 16 KB is out of reach for windows this short.
ORDINARY_BYTES, TOXIC_BYTES = 11_000, 4_500
LONGEST = 8
KEPT_WORDS = 150_000
LEAD = b"\n~ a window of text, to be measured with both ~\n"
TAIL = b"\n12345678\n"
WORD = re.compile(rf"\w{{1,{LONGEST}}}")
PREFIXES = range(3, 8)
# Evidence asked of a beginning: log-likelihood ratio, and rate in toxic over ordinary rows.
EVIDENCE, RATE = 30.0, 5.0
# Penalty of the score's squared weights, for each row and scaled feature.
RIDGE = 1e-3


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=16, chain_log=16, search_log=9, min_match=3, target_length=64,
        strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False,
        write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=options, dict_data=(
        zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))


def _evidence(a: float, b: float, toxic: int, ordinary: int) -> float:
    """Log-likelihood ratio of counts a of ``toxic`` and b of ``ordinary`` rows."""
    share = (a + b) / (toxic + ordinary)
    return 2 * sum(n * math.log(n / (rows * share)) for n, rows in ((a, toxic), (b, ordinary)) if n)


def _forms(word: str) -> list[str]:
    """The beginnings of a word that it is longer than, and the whole word with its end."""
    return [*(word[:size] for size in PREFIXES if size < len(word)), word + " "]


def toxic_words(toxic: list[set[str]], ordinary: list[set[str]]) -> tuple[list[str], list[str]]:
    """Words of toxic rows that begin (or read) as few ordinary ones do, rarest first, and
    the endings that follow such beginnings."""
    rows = (len(toxic), len(ordinary))
    counts = [Counter(w for row in kind for w in row) for kind in (toxic, ordinary)]
    begun: list[dict[str, int]] = [{}, {}]
    for kind, count in zip(begun, counts, strict=True):
        for word, n in count.items():
            for form in _forms(word):
                kind[form] = kind.get(form, 0) + n

    def telling(form: str) -> bool:
        a, b = begun[0][form], begun[1].get(form, 0)
        return a * rows[1] > RATE * (b + 0.5) * rows[0] and _evidence(a, b, *rows) > EVIDENCE

    known: dict[str, bool] = {}
    found, endings = [], Counter()
    for word in counts[0]:
        forms = _forms(word)
        for form in forms:
            if form not in known:
                known[form] = telling(form)
        held = [form for form in forms if known[form]]
        if held:
            found.append(word)
            endings[word[len(held[0]):]] += 1
    return (sorted(found, key=lambda w: (counts[0][w], w)),
            sorted(endings, key=lambda e: (endings[e], e)))


def _window(word: str) -> bytes:
    return f" {word} {word} ".encode("utf-8", "ignore")


class Scorer:
    """Margins and scores of texts under a fitted model."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.ordinary = _compressor(model["ordinary"] + LEAD)
        self.toxic = _compressor(model["ordinary"] + model["toxic"] + LEAD)
        self.kept: dict[str, int] = {}

    def margin(self, word: str) -> int:
        """Bytes that the toxic dictionary saves on the window of a word."""
        known = self.kept.get(word)
        if known is None:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            window = LEAD + _window(word) + TAIL
            known = self.kept[word] = (len(self.ordinary.compress(window))
                                       - len(self.toxic.compress(window)))
        return known

    def features(self, text: str | None) -> np.ndarray:
        """The largest margin, and how many and what share of the windows are at or above
        the threshold and its neighbours."""
        margins = list(map(self.margin, words_of(text)))
        high = [sum(m >= self.model["threshold"] + d for m in margins) for d in (-1, 0, 1)]
        return np.array([1.0, max(margins, default=0), *np.log1p(high),
                         *(np.sqrt(h / max(len(margins), 1)) for h in high)])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.model["weights"],
                                              -30, 30))))


def _threshold(scorer: Scorer, rows: list[tuple[str, int]]) -> int:
    """The margin that parts the labels best by its largest value in a row."""
    most = np.array([max(map(scorer.margin, words_of(t)), default=0) for t, _ in rows])
    labels = np.array([y for _, y in rows])
    rates = {m: np.mean(most[labels == 1] >= m) - np.mean(most[labels == 0] >= m)
             for m in range(1, max(2, int(most.max()) + 1))}
    return max(rates, key=lambda m: (rates[m], -m))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic fit with both labels weighted alike.

    Features are scaled before the penalty, which holds every weight but the first, so that
    labels that a feature parts without error have a finite fit too. A Newton step is halved
    until the penalized likelihood rises; a fit that does not reach its top is an error.
    """
    middle, spread = x.mean(axis=0), x.std(axis=0)
    middle[0], spread = 0, np.where(spread > 1e-9, spread, 1)
    spread[0] = 1
    scaled = (x - middle) / spread
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.diag([1e-6] + [RIDGE * len(y)] * (x.shape[1] - 1))
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, -sign * (scaled @ w)) + w @ penalty @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scaled @ w, -500, 500)))
        gradient = scaled.T @ (weight * (p - y)) + penalty @ w
        if np.abs(gradient).max() < 1e-6 * len(y):
            w = w / spread
            w[0] -= w[1:] @ middle[1:]
            return w
        step = np.linalg.solve(
            (scaled * (weight * p * (1 - p))[:, None]).T @ scaled + penalty, gradient)
        size, now, slope = 1.0, loss(w), gradient @ step
        while loss(w - size * step) > now - 1e-4 * size * slope and size > 1e-12:
            size /= 2
        w = w - size * step
    raise ArithmeticError("the fit of the score did not converge")


def fit(rows: list[tuple[str, int]], share: float) -> dict:
    """A model from labelled texts; every fourth row is kept for calibration."""
    build = [r for i, r in enumerate(rows) if i % 4]
    calibrate = [r for i, r in enumerate(rows) if i % 4 == 0]
    if min(len({y for _, y in build}), len({y for _, y in calibrate})) < 2:
        prior = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return {"ordinary": b" ", "toxic": b" ", "threshold": 1,
                "weights": np.array([prior, *[0] * 7])}
    split: tuple[list[set], list[set]] = ([], [])
    for text, label in build:
        split[1 - label].append(set(words_of(text)))
    telling, endings = toxic_words(*split)
    taken = set(telling)
    # What ends telling words ends ordinary ones too; known to both, it tells nothing.
    shared = " ".join(endings).encode("utf-8", "ignore")[-ORDINARY_BYTES // 2:]
    held = Counter(w for row in split[1] for w in row if w not in taken)
    common = sorted(held, key=lambda w: (held[w], w))  # the most frequent are the nearest
    ordinary = " ".join(common).encode("utf-8", "ignore")[len(shared) - ORDINARY_BYTES:] + shared
    toxic = b"".join(map(_window, telling))[-TOXIC_BYTES:]
    model = {"ordinary": ordinary or b" ", "toxic": toxic or b" ", "threshold": 1}
    scorer = Scorer(model)
    model["threshold"] = _threshold(scorer, calibrate)
    x = np.array([scorer.features(t) for t, _ in calibrate])
    model["weights"] = _logistic(x, np.array([y for _, y in calibrate]))
    return model


def held_out(key: Column) -> Column:
    """Rows that never take part in fitting: one in five by a checksum of the id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, key: str = "doc_id",
                    text: str = "text") -> tuple[list[tuple[str, int]], float]:
    """At most ``fit_rows`` texts of each label, and the share of toxic labels.

    Rows are taken by a hash of their id, below a bound that follows from the counts.
    """
    usable = labels.filter(~held_out(F.col(key)) & F.col("toxic").isin(0, 1)).groupBy(key).agg(
        F.max("toxic").cast("int").alias("_toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("_toxic").count().collect()}
    below = F.lit(0.0)
    for label, n in counts.items():
        below = F.when(F.col("_toxic") == label, F.lit(min(1.0, fit_rows / n))).otherwise(below)
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.filter(place < below).limit(3 * fit_rows)
    # At most 3 fit_rows rows on either side: repeated ids cannot make them more.
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(drawn), key).orderBy(
        F.xxhash64(F.col(key).cast("string")), "_toxic", "_text").limit(3 * fit_rows).collect()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [(r["_text"] or "", r["_toxic"]) for r in rows], share


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on)."""
    rows, share = labelled_sample(docs, labels, fit_rows, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, share))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        scorer = model.get("scorer")
        if scorer is None:
            scorer = model["scorer"] = Scorer(model)
        return pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())

    return docs.drop("score", "predicted").withColumn("score", score(F.col(text))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@apart("score", "predicted")
def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns."""
    return toxicity(docs, labels, **options).filter("predicted = 0").select(*docs.columns)


def accuracy(rows: Iterable[tuple[float, int]]) -> tuple[float, float]:
    """Share of right decisions, and area under the curve, of (score, label) pairs."""
    scores, labels = map(np.array, zip(*rows, strict=True))
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values, start = np.unique(scores[order], return_index=True)
    ends = np.append(start[1:], len(scores))
    ranks[order] = np.repeat((start + ends + 1) / 2, ends - start)
    ones = labels.sum()
    area = (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))
    return float(np.mean((scores >= 0.5) == labels)), float(area)
