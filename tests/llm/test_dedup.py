import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tests.llm.samples import CLASHING, LONG, edge_documents, rows_of
from tidemark.llm import (
    cross_tokens,
    exact_dedup,
    line_dedup,
    mixing,
    pii,
    quality,
    simhash,
    toxicity,
)
from tidemark.llm.components import connected


def test_exact_edges(spark):
    docs = edge_documents(spark)
    out = exact_dedup.exact_duplicates(docs)
    assert set(out.columns) == set(docs.columns) | {"text_sha256", "group_size"}
    groups = defaultdict(list)
    for row in out.collect():
        groups[row.text or ""].append(row)
    for rows in groups.values():
        best = max((r.doc_id for r in rows if r.doc_id is not None), default=None)
        assert {r.keep_id for r in rows} == {best} and {r.group_size for r in rows} == {len(rows)}
        assert [r.doc_id for r in rows if r.kept] == [best]
        assert len({r.text_sha256 for r in rows}) == 1
    assert out.count() == docs.count()
    stays = exact_dedup.without_duplicates(docs)
    assert stays.columns == docs.columns and stays.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_frequent_digests_are_found_and_few(spark):
    random.seed(2)
    texts = ["hot"] * 900 + ["warm"] * 60 + [f"t{random.randrange(400)}" for _ in range(2000)]
    random.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    light = docs.select("doc_id", F.sha2("text", 256).alias("d"))
    found = [r.d for r in exact_dedup.frequent_digests(light, "d", 0.02).collect()]
    wanted = {r.d for r in docs.filter("text IN ('hot', 'warm')").select(
        F.sha2("text", 256).alias("d")).collect()}
    assert wanted <= set(found) and len(found) <= 100
    out = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, share=0.02).collect()}
    for text in set(texts):
        ids = [i for i, t in enumerate(texts) if t == text]
        assert all((out[i].keep_id, out[i].group_size, out[i].kept)
                   == (max(ids), len(ids), i == max(ids)) for i in ids)


def test_frequent_copies_with_equal_or_no_ids(spark):
    rows = ([(9, "same", n) for n in range(300)] + [(3, "same", 0)] * 50 + [(None, "none", 0)] * 200
            + [(n, f"t{n}", n) for n in range(100)] + [(7, "full", 1)] * 150)
    random.Random(6).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(5)
    out = exact_dedup.exact_duplicates(docs, share=0.1)
    got = out.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("stay"),
                                  F.min("group_size").alias("low"), F.max("group_size").alias("high"),
                                  F.max(F.when(F.col("kept"), F.col("doc_id"))).alias("id"))
    sizes = {"same": 350, "none": 200, "full": 150}
    for r in got.collect():
        size = sizes.get(r.text, 1)
        wanted = {"same": 9, "none": None, "full": 7}.get(r.text, int(r.text[1:]) if size == 1 else None)
        assert (r.n, r.stay, r.low, r.high, r.id) == (size, 1, size, size, wanted)
    assert rows_of(out, "doc_id", "text", "extra") == sorted(rows, key=repr)


def test_misra_gries_undercounts_within_its_bound():
    random.seed(4)
    data = ["a"] * 300 + ["b"] * 200 + [str(n) for n in range(1000)]
    random.shuffle(data)
    counters: dict = {}
    exact_dedup.misra_gries(data, counters, 9)
    assert len(counters) <= 9
    for key, n in (("a", 300), ("b", 200)):
        assert n - len(data) / 10 <= counters.get(key, 0) <= n


def fingerprint(text):
    """Brute force, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    texts = ["", None, "One", "one two", "ÀB c\td\ne", "a b c d e f g " * 40, LONG[:5000]]
    wanted = [fingerprint(t) for t in texts]
    for block in (simhash.BLOCK, 5):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [simhash.fingerprint_of(t) % (1 << 64) for t in texts] == wanted


def by_brute_force(prints):
    """Smallest id of each component of ids with fingerprints."""
    parent = {p: p for p in prints.values()}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for key, p in prints.items():
        least[root(p)] = min(key, least.get(root(p), key))
    return {key: least[root(p)] for key, p in prints.items()}


def test_links_and_components_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64).tolist() + [0, (1 << 64) - 1]
    prints = {}
    for n in range(300):
        p = centres[n % len(centres)] % (1 << 64)
        for bit in rng.integers(0, 64, n % 5):
            p ^= 1 << int(bit)
        prints[n] = p
    signed = {n: p - (1 << 64) if p >> 63 else p for n, p in prints.items()}
    distinct = spark.createDataFrame([(p,) for p in set(signed.values())], "_print long")
    found = {(r.node, r.other) for r in simhash.links_of(distinct).collect()}
    values = sorted(set(signed.values()))
    assert found == {(a, b) for i, a in enumerate(values) for b in values[i + 1:]
                     if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    roots = {r.node: r.root for r in connected(simhash.links_of(distinct)).collect()}
    wanted = by_brute_force(prints)
    groups = defaultdict(set)
    for n, p in signed.items():
        groups[roots.get(p, p)].add(wanted[n])
    assert all(len(ids) == 1 for ids in groups.values())
    assert len(groups) == len(set(wanted.values()))


def test_points_are_not_broadcast(spark):
    """They are some fifty times as many as the fingerprints that Spark sizes them by."""
    links = simhash.links_of(spark.range(200).select(F.xxhash64("id").alias("_print")))
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 501), (7, 7)],
                                  "node long, other long")
    roots = {r.node: r.root for r in connected(links).collect()}
    assert roots == {n: 0 for n in range(201)} | {500: 500, 501: 500}


def test_simhash_edges(spark):
    docs = edge_documents(spark)
    out = simhash.near_duplicates(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    known = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    wanted = by_brute_force({k: fingerprint(t) for k, t in known.items()})
    for row in rows:
        if row.doc_id is not None:
            assert row.fingerprint == f"{fingerprint(known[row.doc_id]):016x}"
            assert row.component_id == wanted[row.doc_id]
    stays = simhash.without_near_duplicates(docs)
    assert stays.columns == docs.columns
    ids = [r.doc_id for r in stays.collect()]
    assert {i for i in ids if i is not None} == {k for k in known if wanted[k] == k}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def prose(seed, lines, words=12):
    rng = random.Random(seed)
    return [" ".join(f"{seed}w{rng.randrange(10 ** 6)}" for _ in range(words)) for _ in range(lines)]


def test_passages_are_cut_from_later_documents(spark):
    shared = prose(1, 6)
    texts = {1: prose(2, 3) + shared + prose(3, 2), 2: prose(4, 5),
             3: [*shared[:3], "", *shared[3:], *prose(5, 4)], 4: prose(6, 2) + shared[:2] + prose(7, 2),
             5: shared, 6: [" ".join(prose(8, 1, 60))], 7: ["short", " ".join(prose(8, 1, 60))]}
    docs = spark.createDataFrame([(k, "\n".join(t), "mine") for k, t in texts.items()],
                                 "doc_id long, text string, deduped string")
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[3].deduped.split("\n") == texts[3][7:] and out[3].removed_lines == 7
    assert out[5].deduped == "" and out[5].removed_words == 72
    assert out[7].deduped == "short"
    for k in (1, 2, 4, 6):
        assert out[k].deduped == "\n".join(texts[k]) and out[k].removed_lines == 0


def test_no_long_passage_stays_twice(spark):
    rng = random.Random(9)
    passages = [prose(100 + n, rng.randint(1, 5), 30) for n in range(6)]
    texts = []
    for n in range(40):
        parts = [prose(1000 + n, 2), *rng.sample(passages, 1), prose(2000 + n, 1)]
        texts.append("\n".join(line for part in parts for line in part))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.deduped.split("\n") for r in line_dedup.line_dedup(docs).orderBy("doc_id").collect()]
    for passage in passages:
        held = sum(lines[i:i + len(passage)] == passage for lines in out for i in range(len(lines)))
        wanted = sum("\n".join(passage) in t for t in texts)
        assert held == (min(1, wanted) if 30 * len(passage) >= 50 else wanted)


def test_repeated_and_swapped_passages_are_cut(spark):
    p, q, own = prose(31, 6), prose(32, 6), [prose(40 + n, 2) for n in range(12)]
    texts = [own[0] + p + own[1], own[2] + p + own[3] + p + own[4],
             own[5] + q + own[6] + q, own[7] + q + own[8],
             own[9] + prose(33, 6) + prose(34, 6), prose(34, 6) + own[10] + prose(33, 6) + own[11]]
    docs = spark.createDataFrame([(n, "\n".join(t)) for n, t in enumerate(texts)],
                                 "doc_id long, text string")
    out = [r.deduped.split("\n") for r in line_dedup.line_dedup(docs).orderBy("doc_id").collect()]
    assert [out[n] for n in (0, 2, 4)] == [texts[n] for n in (0, 2, 4)]
    assert out[1] == own[2] + own[3] + own[4]
    assert out[3] == own[7] + own[8]
    assert out[5] == own[10] + own[11]


def test_patience_gives_rising_matches():
    rng = random.Random(0)
    for _ in range(400):
        a = [rng.randint(0, 8) for _ in range(rng.randint(0, 14))]
        b = a[:5] + [rng.randint(0, 8) for _ in range(rng.randint(0, 9))] + a[5:]
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_line_dedup_edges(spark):
    docs = edge_documents(spark)
    out = line_dedup.line_dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"removed_lines", "removed_words"}
    assert rows_of(out, "doc_id", "deduped") == rows_of(docs, "doc_id", "text")
    assert all(c in out.columns for c in CLASHING)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = 4").selectExpr("doc_id + 10 AS doc_id", "text")
    both = line_dedup.line_dedup(docs.select("doc_id", "text").union(twice).union(twice))
    assert [r.deduped for r in both.filter("doc_id = 14").collect()] == ["", ""]


def test_given_columns_come_back(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(n, n % 2, n % 2) for n in range(9)], "doc_id long, toxic int, quality int")
    operators = {
        exact_dedup.exact_duplicates: ("keep_id", "kept", "text_sha256"),
        exact_dedup.without_duplicates: (), simhash.without_near_duplicates: (),
        line_dedup.line_dedup: ("deduped",), mixing.mixture: (),
        mixing.mix_sources: ("size", "taken", "target", "copies"),
        lambda d: toxicity.without_toxic(d, labels): (),
        lambda d: pii.pseudonymise(d, "k"): ("pseudonymised",),
        lambda d: quality.quality(d, labels): ("kept", "score"),
        lambda d: cross_tokens.align_tokenizers(
            d.filter("length(coalesce(text, '')) < 1000"), public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("piece_bpe_32k.model")): (),
    }
    for operator, added in operators.items():
        out = operator(docs)
        given = [c for c in CLASHING if c not in added]
        rows = out.select(*given).distinct().collect()
        assert [tuple(r) for r in rows] == [("mine",) * len(given)]


def test_rows_without_or_with_equal_ids(spark):
    near = "one two three four five six seven eight nine ten"
    rows = [(None, near), (None, f"{near} "), (None, "something else altogether is said here now"),
            (5, near), (5, "another text of the same id, and no copy of it at all"), (9, f" {near}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, simhash.without_near_duplicates(docs).collect()), key=repr)
    assert kept == sorted([rows[2], rows[3], rows[4]], key=repr)
    alone = simhash.without_near_duplicates(docs.filter("doc_id IS NULL")).collect()
    assert len(alone) == 2 and rows[2] in [tuple(r) for r in alone]


def test_lines_do_not_depend_on_the_pieces_of_a_batch(monkeypatch):
    texts = ["a b\n\nc", "", None, LONG, "x y z\n" * 40, "  \t \nw", *(f"t{n} u\nv" for n in range(50))]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "text": texts})
    found = []
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(line_dedup, "PIECE", size)
        parts = list(line_dedup._sequences(3)([batch, batch.slice(0, 0)]))
        rows = pa.Table.from_batches(parts).to_pylist()
        assert [r["doc"] for r in rows] == list(range(len(texts)))
        for row, text in zip(rows, texts, strict=True):
            full = [(n, xxhash.xxh64_intdigest(line) - (1 << 63), len(line.split()))
                    for n, line in enumerate((text or "").encode().split(b"\n")) if line.split()]
            assert [(x["no"], x["hash"], x["words"]) for x in row["lines"]] == full
            assert [x["rank"] for x in row["lines"]] == list(range(len(full)))
        found.append([(r["doc"], r["lines"], set(r["runs"])) for r in rows])
    assert len(parts) < 5 and found[0] == found[1] == found[2]
