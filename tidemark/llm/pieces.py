"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

Text is cut where no piece of the vocabulary can reach across. The distinct cuts of a batch
go into flat symbol arrays; in every round the lowest pair rank of each cut is found by a
segmented minimum, all its leftmost occurrences merge at once, and the arrays are compacted,
until no pair is left. Where a merge could give a pair that goes before the next occurrence,
the order matters, and that cut is finished with a heap, pair by pair.

Defined cases: a null text is empty and has no ids. Characters outside the vocabulary become
byte pieces. Rows are handled one by one: ties and repeated rows change nothing, further
columns are kept, and columns named as the added ones are replaced. An empty table gives an
empty one. Long texts are encoded whole, some hundred thousand characters at a time.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NO_RANK = np.iinfo(np.int64).max
# Encoded cuts that a worker keeps, and characters that it cuts at a time.
KEPT_CUTS, STRIDE = 150_000, 400_000
# Rows that a worker codes at a time.
ROWS = 256


def load_pieces(path: str) -> dict:
    """Pieces with scores and kinds as plain values, read on the driver and broadcast."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.get_piece_size())
    kinds = ["unknown" if model.is_unknown(i) else "control" if model.is_control(i)
             else "byte" if model.is_byte(i) else "piece" for i in numbers]
    pieces = [model.id_to_piece(i) for i in numbers]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(pieces, kinds, strict=True)
           if k == "piece"):
        raise ValueError("pieces that go on over a blank are not supported")
    return {"pieces": pieces, "kinds": kinds,
            "scores": [model.get_score(i) for i in numbers]}


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    """Decoding replaces every invalid byte on its own, as the library does."""
    return "�", error.start + 1


class Coder:
    """Encodes and decodes with the broadcast pieces."""

    def __init__(self, tables: dict) -> None:
        codecs.register_error("byte-by-byte", _byte_by_byte)
        self.pieces, kinds, scores = tables["pieces"], tables["kinds"], tables["scores"]
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True))
                  if k == "piece"}
        self.byte_ids = np.array([i for i, k in enumerate(kinds) if k == "byte"], np.int32)
        letters = sorted({c for p in normal for c in p})
        symbols = dict(normal)
        for c in letters:
            symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for c in letters:
            self.symbol_of[ord(c)] = symbols[c]
        self.base = max(symbols.values()) + 1
        order = {s: r for r, s in enumerate(sorted({-scores[i] for i in normal.values()}))}
        table = sorted((symbols[p[:n]] * self.base + symbols[p[n:]], order[-scores[i]], i)
                       for p, i in normal.items() for n in range(1, len(p))
                       if p[:n] in symbols and p[n:] in symbols)
        self.table = {key: (rank, merged) for key, rank, merged in table}
        self.keys, self.ranks, self.merged = (np.array(c, np.int64)
                                              for c in zip(*table, strict=True))
        self.letters = {s: c for c, s in symbols.items() if s >= len(self.pieces)}
        self._find_risks()
        alone = "".join(c for c in "\n\r\t" if c not in symbols)
        self.cuts = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]"
                               if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.surfaces = [self._surface(p, k) for p, k in zip(self.pieces, kinds, strict=True)]
        self.breaks = {i for i, k in enumerate(kinds) if k in ("control", "unknown")}
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _surface(piece: str, kind: str) -> bytes:
        if kind == "byte":
            return bytes([int(piece[3:5], 16)])
        return {"control": "", "unknown": " ⁇ "}.get(
            kind, piece.replace(MARK, " ")).encode()

    def _find_risks(self) -> None:
        """Marks merges whose result may pair up again at their own rank or before."""
        soonest = np.full(self.base, NO_RANK)
        np.minimum.at(soonest, self.keys // self.base, self.ranks)
        np.minimum.at(soonest, self.keys % self.base, self.ranks)
        self.risky = np.append(soonest[self.merged] <= self.ranks, False)
        self.ranks = np.append(self.ranks, NO_RANK)  # the rank of no pair, at place -1

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table, -1 where there is none."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """Merges one cut pair by pair: lowest rank first, leftmost of equal ranks."""
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                found = self.table.get(symbols[a] * self.base + symbols[b])
                if found and symbols[a] >= 0 and symbols[b] >= 0:
                    heapq.heappush(heap, (found[0], a, b, symbols[a], symbols[b], found[1]))

        for i in range(len(symbols) - 1):
            push(i, i + 1)
        gone = [False] * len(symbols)
        while heap:
            _, a, b, left, right, merged = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or (symbols[a], symbols[b]) != (left, right):
                continue
            symbols[a], gone[b], after[a] = merged, True, after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def merge(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all cuts after all merges, one cut behind the other, and how many
        symbols each cut has."""
        codes = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbol = self.symbol_of[codes]
        # Characters outside the vocabulary keep their code point, as a negative number.
        symbol = np.where(symbol < 0, -1 - codes.astype(np.int64), symbol)
        word = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        place = self._places(symbol, word, np.arange(len(symbol)))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = self.ranks[place]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(symbol)])
            least = np.minimum.reduceat(rank, starts)
            chosen = (rank == np.repeat(least, sizes)) & (place >= 0)
            by_heap = (np.add.reduceat(chosen & self.risky[place], starts) > 0) & (
                np.add.reduceat(chosen, starts) > 1)
            for at, size in zip(starts[by_heap].tolist(), sizes[by_heap].tolist(), strict=True):
                rest = np.array(self._by_heap(symbol[at:at + size].tolist()))
                ended.append((np.full(len(rest), word[at]), rest))
            whole = np.repeat((least == NO_RANK) & ~by_heap, sizes)
            ended.append((word[whole], symbol[whole]))
            chosen &= ~self._overlapping(chosen)
            symbol = np.where(chosen, self.merged[place], symbol)
            stays = np.repeat((least < NO_RANK) & ~by_heap, sizes)
            stays[1:] &= ~chosen[:-1]
            symbol, word, place, chosen = symbol[stays], word[stays], place[stays], chosen[stays]
            changed = chosen.copy()
            changed[:-1] |= chosen[1:]
            at = np.flatnonzero(changed)
            place[at] = self._places(symbol, word, at)
        words = np.concatenate([w for w, _ in ended]) if ended else np.zeros(0, np.int64)
        symbols = np.concatenate([s for _, s in ended]) if ended else words
        order = np.argsort(words, kind="stable")
        return symbols[order], np.bincount(words, minlength=len(cuts))

    def _places(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where in the table the pairs that begin at ``at`` are, -1 for none."""
        after = np.minimum(at + 1, len(symbol) - 1)
        paired = (after > at) & (word[after] == word[at])
        return np.where(paired, self._pairs(symbol[at], symbol[after]), -1)

    @staticmethod
    def _overlapping(chosen: np.ndarray) -> np.ndarray:
        """Every second of neighbouring occurrences, from the left."""
        places = np.arange(len(chosen))
        begins = chosen & ~np.r_[False, chosen[:-1]]
        first = np.maximum.accumulate(np.where(begins, places, 0))
        return chosen & ((places - first) % 2 == 1)

    def _as_ids(self, symbols: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of every cut, packed; characters that are no piece become byte pieces."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.pieces)))
        if len(odd):
            spelled = {s: self.byte_ids[list(self._character(s).encode("utf-8", "surrogatepass"))]
                       for s in np.unique(symbols[odd]).tolist()}
            of_odd = [spelled[s] for s in symbols[odd].tolist()]
            widths = np.ones(len(symbols), np.int64)
            widths[odd] = [len(ids) for ids in of_odd]
            cut = np.repeat(np.arange(len(sizes)), sizes)
            sizes = np.bincount(cut, weights=widths, minlength=len(sizes)).astype(np.int64)
            filled = np.repeat(symbols, widths)
            filled[np.repeat(widths > 1, widths) | (filled < 0) | (filled >= len(self.pieces))
                   ] = np.concatenate(of_odd)
            symbols = filled
        packed = symbols.astype("<i4").tobytes()
        ends = np.cumsum(sizes * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _character(self, symbol: int) -> str:
        return chr(-1 - symbol) if symbol < 0 else self.letters[symbol]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STRIDE):
                size += len(texts[end])
                end += 1
            out += self._encode_some(texts[at:end])
            at = end
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        ends = [0, *np.cumsum([len(m) for m in marked]).tolist()]
        if ends[-1] > 2 * STRIDE:  # one long text: stretches of it, each ended by a cut
            return [b"".join(self._join(list(c)) for c in self._stretches(marked[0]))]
        cut = [self.cuts.findall(m) for m in marked]
        self._learn({c for cs in cut for c in cs})
        return [b"".join(map(self.kept.__getitem__, cs)) for cs in cut]

    def _stretches(self, marked: str):
        gathered, size = [], 0
        for found in self.cuts.finditer(marked):
            gathered.append(found.group())
            size += len(gathered[-1])
            if size > STRIDE:
                yield gathered
                gathered, size = [], 0
        yield gathered

    def _join(self, cuts: list[str]) -> bytes:
        self._learn(set(cuts))
        return b"".join(map(self.kept.__getitem__, cuts))

    def _learn(self, cuts: set[str]) -> None:
        if len(self.kept) > KEPT_CUTS:
            self.kept.clear()
        new = [c for c in cuts if c not in self.kept]
        self.kept.update(zip(new, self._as_ids(*self.merge(new)), strict=True))

    def decode(self, ids: list[int]) -> str:
        if self.breaks.isdisjoint(ids):
            text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "byte-by-byte")
        else:  # special pieces stand between bytes that would else form a character
            parts, begin = [], 0
            for at in [*(n for n, i in enumerate(ids) if i in self.breaks), len(ids)]:
                data = b"".join(map(self.surfaces.__getitem__, ids[begin:at]))
                parts.append(data.decode("utf-8", "byte-by-byte"))
                parts += [self.surfaces[i].decode() for i in ids[at:at + 1]]
                begin = at + 1
            text = "".join(parts)
        return text[1:] if text[:1] == " " and self._begins_blank(ids) else text

    def _begins_blank(self, ids: list[int]) -> bool:
        """Whether the blank put before every text comes first."""
        first = next((i for i in ids if self.surfaces[i]), None)
        return first is not None and self.pieces[first].startswith(MARK)


def _as_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets),
                                    pa.array(np.frombuffer(b"".join(packed), "<i4")))


def coder_functions(spark: SparkSession, path: str):
    """Column functions encode (text to ids) and decode (ids to text), and the function that
    gives a worker its coder."""
    shared = spark.sparkContext.broadcast(load_pieces(path))

    def coder() -> Coder:
        tables = shared.value
        if "coder" not in tables:
            tables["coder"] = Coder(tables)
        return tables["coder"]

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _as_lists(coder().encode_all([t or "" for t in texts.to_pylist()]))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        with_pieces = coder()
        return pa.array([with_pieces.decode(i.as_py() or []) for i in ids], pa.string())

    return encode, decode, coder


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids: the pieces of each whole text."""
    encode, _, _ = coder_functions(docs.sparkSession, path)
    return docs.drop("ids").withColumn("ids", encode(F.col(text)))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Adds decoded: the text of ids."""
    _, decode, _ = coder_functions(rows.sparkSession, path)
    return rows.drop("decoded").withColumn("decoded", decode(F.col("ids")))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids and decoded, reading each text once and a few rows at a time."""
    _, _, coder = coder_functions(docs.sparkSession, path)
    base = docs.drop("ids", "decoded")
    at = base.columns.index(text)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_pieces = coder()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                packed = with_pieces.encode_all([t or "" for t in part.column(at).to_pylist()])
                read = [with_pieces.decode(np.frombuffer(p, "<i4").tolist()) for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _as_lists(packed), pa.array(read, pa.string())],
                    [*part.schema.names, "ids", "decoded"])

    added = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return base.mapInArrow(code, T.StructType([*base.schema.fields, *added.fields]))
