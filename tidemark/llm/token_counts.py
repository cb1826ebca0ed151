"""Token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

Two transducers in a row. The first cuts text into pre-tokens: whether a boundary lies
before a character depends on the classes of its neighbours only, so it runs over arrays of
character classes. The second reads the bytes of a pre-token: its states are what the
encodings of the prefixes read so far leave open, and every transition carries the tokens it
adds (a merge takes some back). Transitions are compiled when first taken and kept, so a
pre-token costs one step a byte.

Texts are read in chunks. A chunk is a map from the state before it to the state after it:
the text up to its first certain cut and after its last one, which wait for the neighbours,
and the tokens between. Maps compose associatively, so the chunks of a text are folded by
a prefix scan in pairs.

Defined cases: a null text is empty and has no tokens. Special strings inside texts are the
special tokens, as is the library's default. Rows are counted one by one: ties and repeated
rows change nothing, further columns are kept, and columns named as the added ones are
replaced. An empty table gives an empty one. Long texts are read whole, chunk by chunk.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16
# Compiled transitions and counted pre-tokens that a worker keeps; beyond, it starts afresh.
KEPT_STATES, KEPT_WORDS = 200_000, 400_000

SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE = range(1, 7)
# Fixed values of the tokenizer's pattern: what may follow an apostrophe as one token.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def class_table() -> bytes:
    """The class of every code point."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(
        map(chr, range(0xE000, 0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"),
                            (BLANK, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            table[found.start():found.end()] = number
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table.tobytes()


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """Merges as byte strings in order, special tokens, and character classes.

    Read on the driver and broadcast: a vocabulary is of bounded size.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    to_byte = byte_characters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    merges = [tuple(bytes(to_byte[c] for c in part) for part in pair) for pair in pairs]
    return {"merges": merges, "classes": class_table(),
            "special": [t["content"] for t in model["added_tokens"]]}


class Transducer:
    """Counts the BPE tokens of a byte string, one deterministic step a byte.

    After each prefix exactly one token can be the last of the prefix's encoding: the one
    whose own start leaves a last token that it does not merge with. A state holds, for the
    longest suffix that begins a token, the last token and the count at every place inside.
    Every token of the vocabulary has to encode to itself, as trained ones do.
    """

    def __init__(self, merges: list) -> None:
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in merges}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.begins = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        start = (b"", (None,), (0,))
        self.states, self.numbers = [start], {start: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.stands: dict[tuple, bool] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token at one of its ends, smallest first, each with the rank of
        the merge that takes it up (none for the token itself)."""
        spine, taken = [], len(self.ranks)
        while True:
            spine.append((token, taken))
            if len(token) == 1:
                return spine[::-1]
            taken, token = self.ranks[self.halves[token]], self.halves[token][side]

    def _merge_across(self, left: bytes, right: bytes) -> bool:
        """Whether merging joins parts of the two tokens before each is complete.

        Merges go by rank, leftmost first. Of the two parts at the border, the one with the
        lower rank is taken up next, unless the pair across the border comes before.
        """
        lefts, rights = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = lefts[i], rights[j]
            rank = self.ranks.get((a, b))
            if rank is not None and rank < a_taken and rank <= b_taken:
                return True
            if i + 1 == len(lefts) and j + 1 == len(rights):
                return False
            if a_taken <= b_taken and i + 1 < len(lefts):
                i += 1
            else:
                j += 1

    def _stand(self, left: bytes | None, right: bytes) -> bool:
        """Whether two tokens side by side stay as they are."""
        if left is None:
            return True
        known = self.stands.get((left, right))
        if known is None:
            known = self.stands[left, right] = not self._merge_across(left, right)
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        suffix, lasts, counts = self.states[key >> 8]
        longer = suffix + bytes([key & 255])
        last = count = None
        for start in range(len(longer)):
            token = longer[start:]
            if token in self.tokens and self._stand(lasts[start], token):
                last, count = token, counts[start] + 1
                break
        # Places from which no token can go on are alike; blanking them merges states.
        open_at = [longer[n:] in self.begins for n in range(len(longer) + 1)]
        cut = open_at.index(True)
        state = (longer[cut:],
                 tuple(t if o else None for t, o in zip((*lasts, last)[cut:], open_at[cut:])),
                 tuple(c - count if o else 0
                       for c, o in zip((*counts, count)[cut:], open_at[cut:])))
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        self.steps[key] = step = (number << 8, count)
        return step

    def count(self, data: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self.reset()
        steps, state, total = self.steps, 0, 0
        for byte in data:
            step = steps.get(state | byte) or self._compile(state | byte)
            state = step[0]
            total += step[1]
        return total


class ChunkMap(NamedTuple):
    """What a chunk does: text before its first certain cut, tokens, text after its last."""
    head: str
    count: int
    tail: str | None


class Counter:
    """Counts tokens of texts from the broadcast tables."""

    def __init__(self, tables: dict) -> None:
        self.classes = np.frombuffer(tables["classes"], np.uint8)
        self.special = tables["special"]
        self.transducer = Transducer(tables["merges"])
        self.words: dict[str, int] = {}

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Whether a pre-token begins at each character, and whether that is certain
        whatever surrounds the text: a blank behind anything else."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.classes[codes]
        blank = kind <= BLANK
        group = np.where(blank, 0, np.where(kind == QUOTE, OTHER, kind))
        begins = np.ones(len(kind), bool)
        before, after = slice(None, -1), slice(1, None)
        change = group[before] != group[after]
        certain = np.zeros(len(kind), bool)
        certain[1:] = ~blank[before] & blank[after]
        begins[1:] = change & (kind[before] != SPACE)
        last_blank = np.zeros(len(kind), bool)  # of a run of blanks that something follows
        last_blank[:-1] = blank[before] & ~blank[after]
        begins[1:] |= blank[before] & last_blank[after]
        quotes = np.flatnonzero(kind == QUOTE)
        if len(quotes):
            self._contractions(text, kind, begins, quotes)
        return begins, certain

    @staticmethod
    def _contractions(text: str, kind: np.ndarray, begins: np.ndarray, quotes: np.ndarray) -> None:
        free = (quotes == 0) | np.isin(kind[quotes - 1], (LETTER, NUMBER, BLANK))
        for at in quotes[free].tolist():
            size = (2 if text[at + 1:at + 2] in SHORT_ENDINGS
                    else 3 if text[at + 1:at + 3] in LONG_ENDINGS else 0)
            if size:
                begins[at + 1:at + size] = False
                if at + size < len(begins):
                    begins[at + size] = True

    def _between(self, text: str, places: np.ndarray) -> int:
        """Tokens of the pre-tokens that begin at the places, up to the text's end."""
        words = self.words
        if len(words) > KEPT_WORDS:
            words.clear()
        total, starts = 0, places.tolist()
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            word = text[a:b]
            known = words.get(word)
            if known is None:
                known = self.transducer.count(word.encode("utf-8", "surrogatepass"))
                if b - a < 64:
                    words[word] = known
            total += known
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text that is cut nowhere."""
        return self._between(text, np.flatnonzero(self.boundaries(text)[0])) if text else 0

    def chunk(self, text: str) -> ChunkMap:
        cuts = np.flatnonzero(self.boundaries(text)[1])
        if not len(cuts):
            return ChunkMap(text, 0, None)
        first, last = int(cuts[0]), int(cuts[-1])
        return ChunkMap(text[:first], self.plain(text[first:last]), text[last:])

    def compose(self, one: ChunkMap, two: ChunkMap) -> ChunkMap:
        """The map of two chunks in a row."""
        if one.tail is None:
            return ChunkMap(one.head + two.head, two.count, two.tail)
        if two.tail is None:
            return ChunkMap(one.head, one.count, one.tail + two.head)
        return ChunkMap(one.head, one.count + self.plain(one.tail + two.head) + two.count,
                        two.tail)

    def scan(self, text: str) -> int:
        maps = [self.chunk(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            pairs = zip(maps[::2], maps[1::2], strict=False)
            maps = [self.compose(a, b) for a, b in pairs] + maps[len(maps) & ~1:]
        return sum(self.plain(m.head) + m.count + self.plain(m.tail or "") for m in maps)

    def tokens(self, text: str | None) -> int:
        parts, total = [text or ""], 0
        for special in self.special:
            split = [part.split(special) for part in parts]
            total += sum(len(s) - 1 for s in split)
            parts = [piece for s in split for piece in s]
        return total + sum(self.plain(p) if len(p) <= CHUNK else self.scan(p) for p in parts)


def token_counter(spark: SparkSession, path: str):
    """A column function that counts tokens; workers keep what they have compiled."""
    shared = spark.sparkContext.broadcast(load_tables(path))

    @F.arrow_udf("long")
    def count_tokens(texts: pa.Array) -> pa.Array:
        tables = shared.value
        counter = tables.get("counter")
        if counter is None:
            counter = tables["counter"] = Counter(tables)
        return pa.array([counter.tokens(t.as_py()) for t in texts], pa.int64())

    return count_tokens


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    count = token_counter(docs.sparkSession, path)
    base = docs.drop("n_bytes", "n_tokens", "over_limit")
    return base.withColumn(
        "n_bytes", F.octet_length(F.coalesce(text, F.lit(""))).cast("long")).withColumn(
        "n_tokens", count(F.col(text))).withColumn("over_limit", F.col("n_tokens") > limit)
