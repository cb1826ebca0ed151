"""Alignment of two tokenizers' tokens over a corpus, each distinct text read once.

Exact-text deduplication: texts are counted by a shuffle on the full text, so each distinct
one is tokenised and aligned once, and what it adds to corpus-wide counts is weighted by its
multiplicity. The measures of a text then go back to the ids of its copies by digest; digests
that many rows share are joined by a broadcast of bounded size, the others by a shuffle.

Tokens of both tokenizers cover the same bytes. Offsets where both have a token's end cut them
into groups, and the last tokens of a group, which end together, are linked. Of two tokens that
end together one ends with the other, so the pairs that can ever be linked follow from the two
vocabularies alone (some hundred thousands): they are numbered, and counts of pairs are arrays
of that size, whatever the corpus.

A text is read in units that begin at a blank behind something else: neither tokenizer has a
token across such a place, so a unit is tokenised and aligned the same wherever it stands, and
workers keep what they have learned of short ones. The tokenizers' libraries tokenise units,
and numpy aligns all new units of a batch in one go.

Defined cases: a null text is empty. Empty texts, and texts whose bytes either tokenizer does
not give back, have no tokens: zeros and an empty string. Further columns are kept, and columns
named as the added ones are replaced. Rows are joined by the digest of their text, so ties,
null ids and repeated rows change nothing but multiplicities. An empty table gives an empty
one. Long texts are read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.exact_dedup import frequent_digests
from tidemark.llm.names import spare
from tidemark.llm.token_counts import byte_characters
from tidemark.session import written

# Units that a worker keeps, and the longest that it keeps; rows aligned at a time.
KEPT_UNITS, KEPT_LENGTH, ROWS = 400_000, 32, 512
# A digest that holds this share of the rows meets its measures by a broadcast.
SHARE = 0.002
# The characters that Unicode calls white space.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BUT_SPACE = BLANKS.replace(" ", "")
UNIT = re.compile(f"[{BLANKS}]*[^{BLANKS}]+(?:[{BUT_SPACE}][{BLANKS}]*[^{BLANKS}]+)*"
                  f"(?:[{BLANKS}]+\\Z)?|[{BLANKS}]+")
BLANK_BEFORE_SPACE = re.compile(f"[{BLANKS}] ")
# Units of other characters, and long ones, go through the tokenizers library one by one; for
# the rest, which are the many, tiktoken gives the same tokens faster.
ODD = re.compile("[^\0-\u024f]")
LONG_UNIT = 200
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens keep their text."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    to_byte = byte_characters()
    tokens = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
              for t, i in model["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def piece_vocabulary(path: str) -> list[bytes]:
    """The bytes of each piece: blanks for their mark, bytes for byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)]


def pair_keys(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Sorted keys (id of the first * size of the second + id of the second) of all pairs of
    tokens of which one ends with the other: the only ones that can end together."""
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for held, tokens in zip(by_bytes, (first, second), strict=True):
        for i, token in enumerate(tokens):
            if token:
                held.setdefault(token, []).append(i)
    keys = [a * len(second) + b
            for token, ids in by_bytes[0].items() for n in range(len(token))
            for b in by_bytes[1].get(token[n:], ()) for a in ids]
    keys += [a * len(second) + b
             for token, ids in by_bytes[1].items() for n in range(1, len(token))
             for a in by_bytes[0].get(token[n:], ()) for b in ids]
    return np.array(sorted(keys), np.int64)


def units_of(text: str) -> list[str]:
    """The units of a text with a space before it, each without the space it begins with."""
    spaced = f" {text}"
    if spaced[-1] == " " or BLANK_BEFORE_SPACE.search(spaced):
        return [u[1:] for u in UNIT.findall(spaced)]
    return text.split(" ")


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


class Aligner:
    """Tokenises and aligns texts; made once in a worker from the broadcast tables."""

    def __init__(self, tables: dict) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_str(tables["first_model"])
        self.first.encode_special_tokens = True
        self.fast = tiktoken.Encoding(
            "first", pat_str=tables["pattern"], special_tokens={},
            mergeable_ranks=tables["ranks"]) if tables["ranks"] else None
        self.second = sentencepiece.SentencePieceProcessor(model_proto=tables["second_model"])
        self.bytes = tables["first"], tables["second"]
        self.lengths = [np.array([len(t) for t in tokens], np.int64) for tokens in self.bytes]
        self.keys = tables["keys"]
        self.marked = [f"{i}{mark}".encode() for tokens, marks in
                       zip(self.bytes, (",|", ",;"), strict=True)
                       for i in range(len(tokens)) for mark in marks]
        self.kept: dict[str, tuple] = {}

    def _first_ids(self, units: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first tokenizer, and how many each unit has; the first ``plain`` units
        go as one text, which is cut at their ends."""
        joined = "".join([f" {u}" for u in units[:plain]])
        ids = np.array(self.fast.encode_ordinary(joined) if joined else [], np.int64)
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in units[:plain]])
        cut = np.searchsorted(np.cumsum(self.lengths[0][ids]), ends) + 1
        rest = [e.ids for e in self.first.encode_batch(
            [f" {u}" for u in units[plain:]], add_special_tokens=False)]
        return (np.concatenate([ids, _flat(rest)]),
                np.concatenate([np.diff(cut, prepend=0), [len(r) for r in rest]]).astype(np.int64))

    def _whole(self, ids: np.ndarray, sizes: np.ndarray, side: int, data: list[bytes]) -> np.ndarray:
        """Whether each unit's tokens give its bytes back."""
        tokens = list(map(self.bytes[side].__getitem__, ids.tolist()))
        if b"".join(tokens) == b"".join(data):
            ends = np.cumsum(np.append(0, self.lengths[side][ids]))[np.cumsum(sizes)]
            if np.array_equal(ends, np.cumsum([len(d) for d in data])):
                return np.ones(len(data), bool)
        ends = [0, *np.cumsum(sizes).tolist()]
        return np.array([b"".join(tokens[a:b]) == d for a, b, d in
                         zip(ends, ends[1:], data, strict=False)], bool)

    def learn(self, units: list[str]) -> dict[str, tuple]:
        """Alignments of units, all in one go: of each its tokens on both sides, packed pair
        numbers, groups as text, and whether its tokens give it back."""
        odd = {u for u in units if not self.fast or len(u) > LONG_UNIT or ODD.search(u)}
        units = [*(u for u in units if u not in odd), *odd]
        a, sizes_a = self._first_ids(units, len(units) - len(odd))
        coded = self.second.encode(units, num_threads=1)
        b, sizes_b = _flat(coded), np.array([len(ids) for ids in coded], np.int64)
        data = [f" {u}".encode("utf-8", "surrogatepass") for u in units]
        whole = self._whole(a, sizes_a, 0, data) & self._whole(b, sizes_b, 1, data)
        if not whole.all():
            a, b = a[np.repeat(whole, sizes_a)], b[np.repeat(whole, sizes_b)]
            sizes_a, sizes_b = sizes_a * whole, sizes_b * whole
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        keys = a[last_a] * len(self.bytes[1]) + b[last_b]
        links = np.searchsorted(self.keys, keys)
        if len(keys) and not np.array_equal(self.keys[np.minimum(links, len(self.keys) - 1)], keys):
            raise AssertionError("two tokens end together and neither ends with the other")
        words = self._groups(a, b, last_a, last_b)
        # Where each unit's tokens and groups end; every unit ends with a group.
        to_a, to_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        to_link = (4 * np.searchsorted(last_a, to_a)).tolist()
        to_word = (to_a + to_b).tolist()
        packed = links.astype("<i4").tobytes()
        return {u: (n_a, n_b, packed[l0:l1], b"".join(words[w0:w1]), good)
                for u, n_a, n_b, l0, l1, w0, w1, good in zip(
                    units, sizes_a.tolist(), sizes_b.tolist(), [0, *to_link], to_link,
                    [0, *to_word], to_word, whole.tolist(), strict=False)}

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray,
                last_b: np.ndarray) -> list[bytes]:
        """All ids with their marks, group by group: first the one side, then the other."""
        final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        final_a[last_a] = final_b[last_b] = 1
        group_a, group_b = (np.cumsum(f) - f for f in (final_a, final_b))
        until_a, until_b = np.append(0, last_a + 1), np.append(0, last_b + 1)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + until_b[group_a]] = a * 2 + final_a
        order[np.arange(len(b)) + until_a[group_b + 1]] = (
            (b + len(self.bytes[0])) * 2 + final_b)
        return list(map(self.marked.__getitem__, order.tolist()))

    def align(self, texts: list[str]) -> list[tuple[int, int, bytes, bytes]]:
        """Of each text: tokens of both sides, packed pair numbers, and groups as text."""
        cut = [units_of(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        known = self.kept
        new = set(chain.from_iterable(cut)).difference(known)
        if new:
            learned = self.learn(sorted(new))
            known.update(learned)
        out = []
        for units in cut:
            n_a, n_b, links, groups, whole = zip(*map(known.__getitem__, units), strict=True) \
                if units else ((),) * 5
            out.append((sum(n_a), sum(n_b), b"".join(links), b"".join(groups)[:-1])
                       if all(whole) else (0, 0, b"", b""))
        for unit in new:
            if len(unit) > KEPT_LENGTH:
                del known[unit]
        return out


def load(first: str, second: str) -> dict:
    """Both models and their linkable pairs, read on the driver and broadcast: they are as
    large as the vocabularies."""
    tables: dict = {"first": byte_vocabulary(first), "second": piece_vocabulary(second)}
    with open(first, encoding="utf-8") as file:
        tables["first_model"] = file.read()
    with open(second, "rb") as file:
        tables["second_model"] = file.read()
    tables["keys"] = pair_keys(tables["first"], tables["second"])
    tables["pattern"] = public_tokenizers.PATTERN
    tables["ranks"] = _ranks(tables["first_model"])
    return tables


def _ranks(model: str) -> dict[bytes, int] | None:
    """Tokens by id where ids go by merge, so that the lowest id is the next merge; else None."""
    held, to_byte = json.loads(model), byte_characters()
    vocabulary = held["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
    merged = [vocabulary["".join(pair)] for pair in merges]
    if merged != sorted(set(merged)) or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    special = {t["content"] for t in held["added_tokens"]}
    return {bytes(to_byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}


ALIGNED = ("digest string, times long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, pairs array<int>, counts array<int>")


def aligned_texts(texts: DataFrame, shared) -> DataFrame:
    """Digest, multiplicity and alignment of each distinct text; pairs are its distinct pair
    numbers, counts how often the text links them."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        if "aligner" not in tables:
            tables["aligner"] = Aligner(tables)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows, pairs, counts = [], [], []
                for n_a, n_b, links, groups in tables["aligner"].align(part.column(2).to_pylist()):
                    found, times = np.unique(np.frombuffer(links, "<i4"), return_counts=True)
                    pairs.append(found)
                    counts.append(times.astype(np.int32))
                    size = len(links) // 4
                    rows.append((n_a, n_b, size, size,
                                 hashlib.sha256(groups).hexdigest() if groups else ""))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v), pa.int32()))
                         for v in (pairs, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns, *lists],
                    [c.split()[0] for c in ALIGNED.split(", ")])
    return texts.mapInArrow(align, ALIGNED)


def _values(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How many links of the corpus hold each pair: one row a pair reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            per_text = np.diff(batch.column(1).offsets.to_numpy())
            times = np.repeat(batch.column(0).to_numpy(), per_text)
            np.add.at(total, _values(batch.column(1)), _values(batch.column(2)) * times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": total[at]})

    counted = aligned.select("times", "pairs", "counts").mapInArrow(
        count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in counted.collect():
        counts[row["pair"]] = row["n"]
    return counts


def best_pairs(counts: np.ndarray, keys: np.ndarray, second_size: int) -> np.ndarray:
    """Whether a pair's count is the highest of its second token."""
    highest = np.zeros(second_size, np.int64)
    np.maximum.at(highest, keys % second_size, counts)
    return (counts > 0) & (counts == highest[keys % second_size])


def text_measures(aligned: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """Digest and all measures of each distinct text."""
    shared = aligned.sparkSession.sparkContext.broadcast((counts, best))
    plain = ["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, highest = shared.value
        for batch in batches:
            lists = batch.column(len(plain))
            pairs, times = _values(lists), _values(batch.column(len(plain) + 1)).astype(np.int64)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.append(0, np.cumsum(v)) for v in (times * highest[pairs], times * count[pairs])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in range(len(plain))),
                 *(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)],
                [*plain, "n_best", "count_sum"])

    return aligned.select(*plain, "pairs", "counts").mapInArrow(
        measure, "digest string, n_a long, n_b long, n_groups long, n_links long, "
                 "groups_sha256 string, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """Adds the columns of ``MEASURES`` to every row.

    ``first`` is the file of a byte-level vocabulary, ``second`` that of a piece model.
    """
    base = docs.drop(*({*MEASURES} - {text}))
    digest, known = spare(base.columns, "_digest", "_known")
    given = F.coalesce(F.col(text), F.lit(""))
    spark = docs.sparkSession
    tables = load(first, second)
    distinct = base.groupBy(given.alias("text")).agg(F.count(F.lit(1)).alias("times")).select(
        F.sha2("text", 256).alias("digest"), "times", "text")
    aligned = written(aligned_texts(distinct, spark.sparkContext.broadcast(tables)), "aligned")
    counts = pair_counts(aligned, len(tables["keys"]))
    best = best_pairs(counts, tables["keys"], len(tables["second"]))
    measures = written(text_measures(aligned, counts, best), "measures").withColumnRenamed(
        "digest", digest)
    tagged = base.withColumn(digest, F.sha2(given, 256))
    if text in MEASURES:
        tagged = tagged.drop(text)
    # At most 2 / SHARE digests are frequent, and each has one row of measures.
    frequent = written(measures.join(F.broadcast(frequent_digests(
        tagged.select(digest), digest, SHARE)), digest).withColumn(known, F.lit(True)),
        "frequent-measures")
    split = tagged.join(F.broadcast(frequent.select(digest, known)), digest, "left")
    hot = split.filter(known).drop(known).join(F.broadcast(frequent.drop(known)), digest)
    others = split.filter(F.col(known).isNull()).drop(known).join(measures, digest)
    return hot.unionByName(others).drop(digest)
