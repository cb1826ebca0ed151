"""Audit of five text filters: what each removes alone, in every order, and by mistake.

Filters A to D read one text each. E fails a text that a smaller id holds too, which needs
all texts: compressed (radix) tries find it. A trie node's edges hold stretches of text, so
texts that begin alike share them, and the terminal of a whole text holds the smallest id.

1. Where documents are read, some megabytes of texts at a time go into a trie. Rows above the
   smallest id of their terminal fail E and are settled without their text; one row a text
   (id and language) goes on. A text that a third of all rows hold thus leaves each task a few
   times at most.
2. The rows that go on are range-partitioned by a prefix of their text. Prefixes adapt: one
   that holds more than a quarter of a partition's bytes is lengthened fourfold, again and
   again, until none is too heavy or it is a whole text. Equal texts have equal prefixes.
3. A trie a partition holds its texts; a row above its terminal's smallest id fails E.
4. Each document is now a mask of failed filters. Masks are counted by part and label, and
   the 120 orders are read off the counts.

Defined cases: a null text or part is empty. A null id is not smaller than any; it fails E if
any other row of the same text has an id. Rows that share id and text do not fail by each
other. Of repeated labels the largest counts. Rows with a null id have no labels. Further
columns are not carried: the result counts documents. An empty table gives no rows. Long texts
are inserted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import written

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
# Bytes of text in a trie where documents are read, and that a partition should hold.
BUFFER, PARTITION = 32 << 20, 16 << 20
# Code points of the first prefix, its growth, and the most prefixes lengthened at a time.
FIRST, GROWTH, MOST = 16, 4, 1 << 20
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = re.compile(rb"[#$%&*|]")
COPY = 1 << LETTERS.index("E")


class Trie:
    """Whole texts in a compressed trie; each has a number, in order of first insertion."""

    def __init__(self) -> None:
        # A node is [edges by first byte, number of the text that ends here or -1]; an edge
        # is [stretch of text, node].
        self.root: list = [{}, -1]
        self.size = 0

    def insert(self, text: bytes) -> int:
        """The number of the text."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                node[0][text[at]] = edge = [text[at:], [{}, -1]]
            stretch = edge[0]
            if not text.startswith(stretch, at):
                shared = _shared(stretch, text, at)
                edge[:] = [stretch[:shared], [{stretch[shared]: [stretch[shared:], edge[1]]}, -1]]
                stretch = edge[0]
            at += len(stretch)
            node = edge[1]
        if node[1] < 0:
            node[1] = self.size
            self.size += 1
        return node[1]


def _shared(stretch: bytes, text: bytes, at: int) -> int:
    """How many leading bytes of the stretch the text has at a place; not all of them."""
    low, high = 0, min(len(stretch), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(stretch[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def text_mask(data: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = data.split()  # bytes are split at ASCII blanks only
    capitals = len(data) - len(data.translate(None, CAPITALS))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
              100 * capitals > 10 * code_points, MARKS.search(data) is not None)
    return sum(1 << n for n, f in enumerate(failed) if f)


def _smallest(numbers: list[int], ids: list, size: int) -> list:
    """The smallest id of each numbered text, None if all are null."""
    least: list = [None] * size
    for number, key in zip(numbers, ids, strict=True):
        if key is not None and (least[number] is None or key < least[number]):
            least[number] = key
    return least


def _settle(texts: list[bytes], ids: list, parts: list, masks: list, schema: pa.Schema):
    """Rows of one buffer: those that fail E for good, and one for each text that goes on."""
    trie = Trie()
    numbers = [trie.insert(t) for t in texts]
    least = _smallest(numbers, ids, trie.size)
    done, on = [], Counter()
    text_of: dict[int, bytes] = {}
    for number, key, part, mask, text in zip(numbers, ids, parts, masks, texts, strict=True):
        if key != least[number]:
            done.append((key, part, mask | COPY, 1, None))
        else:
            on[number, key, part, mask] += 1
            text_of[number] = text
    done += [(key, part, mask, n, text_of[number].decode("utf-8", "surrogatepass"))
             for (number, key, part, mask), n in on.items()]
    columns = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _measure(key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("part", pa.string()), ("mask", pa.int32()),
                        ("n", pa.int64()), ("text", pa.string())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            for key, part, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       batch.column(2), strict=True):
                text = cell.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                for column, value in zip(held, (data, key, part, text_mask(data, len(text))),
                                         strict=True):
                    column.append(value)
                size += len(data) + 64
                if size > BUFFER:
                    yield _settle(*held, schema)
                    held, size = ([], [], [], []), 0
        if held[0]:
            yield _settle(*held, schema)
    return measure


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition without their texts, masks with E where it fails."""
    trie, numbers, light = Trie(), [], []
    for batch in batches:
        numbers += [trie.insert(t.as_py().encode("utf-8", "surrogatepass"))
                    for t in batch.column(4)]
        light.append(batch.select([0, 1, 2, 3]))
    at = 0
    least = _smallest(numbers, [k for b in light for k in b.column(0).to_pylist()], trie.size)
    for batch in light:
        ids, masks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        masks = [m | COPY if k != least[number] else m for m, k, number in
                 zip(masks, ids, numbers[at:at + len(ids)], strict=True)]
        at += len(ids)
        yield batch.set_column(2, "mask", pa.array(masks, pa.int32()))


def by_prefix(rows: DataFrame, text: str, partition: int = PARTITION) -> DataFrame:
    """The rows dealt out by ranges of adaptive prefixes of their text.

    A prefix that holds more than a quarter of a partition's bytes is lengthened for its rows.
    At most ``MOST`` prefixes can be as heavy, so what tells them apart stays of bounded size.
    """
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    heavy = max(partition // 4, total // MOST)
    prefix, length = F.substring(text, 1, FIRST), FIRST
    dealt = rows.withColumn("prefix", prefix)
    pending = dealt
    while True:
        sums = pending.groupBy("prefix").agg(
            F.sum(F.octet_length(text)).alias("bytes"), F.max(F.length(text)).alias("longest"))
        crowded = written(sums.filter((F.col("bytes") > heavy) & (F.col("longest") > length))
                          .select("prefix", F.lit(True).alias("crowded")), "prefixes")
        if crowded.isEmpty():
            break
        length *= GROWTH
        longer = F.substring(text, 1, length)
        marked = dealt.join(F.broadcast(crowded), "prefix", "left")
        dealt = marked.withColumn("prefix", F.when(F.col("crowded"), longer).otherwise(
            F.col("prefix"))).drop("crowded")
        pending = dealt.filter(F.length("prefix") > length // GROWTH)
    count = max(1, -(-total // partition))
    return dealt.repartitionByRange(count, "prefix").drop("prefix")


def failed_masks(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 part: str = "lang") -> DataFrame:
    """key, part, mask of failed filters and n: every row, alike rows of one id together."""
    given = docs.select(F.col(key).alias("key"), F.coalesce(part, F.lit("")).alias("part"),
                        F.col(text).alias("text"))
    kind = given.schema["key"].dataType
    schema = f"key {kind.simpleString()}, part string, mask int, n long"
    measured = written(given.mapInArrow(_measure(to_arrow_type(kind)), f"{schema}, text string"),
                       "measured")
    open_ = by_prefix(measured.filter("text IS NOT NULL"), "text")
    flagged = open_.mapInArrow(_flag, schema)
    return measured.filter("text IS NULL").drop("text").unionByName(flagged)


def labelled_masks(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents by part, mask, good and toxic."""
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    summed = masks.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    joined = summed.filter("key IS NOT NULL").join(known, "key", "left").drop("key")
    alone = summed.filter("key IS NULL").select(
        "part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return joined.unionByName(alone).groupBy(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def _bits(letters: str) -> int:
    return sum(1 << LETTERS.index(c) for c in letters)


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step from documents by part, mask and label."""
    steps = range(1, len(LETTERS) + 1)

    def looked_up(values: list) -> Column:
        return F.element_at(F.lit(values), F.col("at") * len(LETTERS) + F.col("step"))

    spread = written(counts, "mask-counts").withColumn(
        "at", F.explode(F.lit([*range(len(ORDERS))]))).withColumn(
        "step", F.explode(F.lit([*steps]))).withColumn(
        "bit", looked_up([_bits(o[s - 1]) for o in ORDERS for s in steps])).withColumn(
        "before", looked_up([_bits(o[:s - 1]) for o in ORDERS for s in steps]))
    reached = F.col("mask").bitwiseAND(F.col("before")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def documents(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    rows = spread.groupBy("part", "at", "step", "bit").agg(
        documents(reached & ~fails).alias("kept"),
        documents(reached & fails).alias("removed"),
        documents(~reached & fails).alias("redundant"),
        documents(F.col("mask") == F.col("bit")).alias("unique_fails"),
        documents(reached & fails & F.col("good")).alias("good_lost"),
        documents(reached & fails & F.col("toxic")).alias("toxic_lost"))
    shapley = F.sum("removed").over(W.partitionBy("part", "bit"))
    return rows.withColumn("shapley", shapley).select(
        "part", F.element_at(F.lit(ORDERS), F.col("at") + 1).alias("filter_order"),
        F.col("step").cast("int").alias("step"), "kept", "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 part: str = "lang") -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(labelled_masks(failed_masks(docs, key, text, part), labels, key))
