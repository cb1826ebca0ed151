import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import neighbours, queries


def exact(rows, query, k):
    """Brute force in double precision."""
    here = rows[query]

    def cosine(v):
        return sum(a * b for a, b in zip(here, v, strict=True)) / math.sqrt(
            sum(a * a for a in here)) / math.sqrt(sum(b * b for b in v))

    scored = sorted(((-cosine(v), i) for i, v in rows.items() if i != query))
    return [(i, -s) for s, i in scored[:k]]


def test_all_is_found_where_leaves_hold_all(spark):
    rng = np.random.default_rng(0)
    rows = {i: [float(x) for x in rng.integers(-3, 4, 6)] for i in range(300)}
    rows = {i: v for i, v in rows.items() if any(v)}
    same = rows[min(rows)]
    rows |= {1000 + i: same for i in range(200)}  # one very common vector
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    df = df.union(df.limit(3)).withColumn("score", F.lit("mine"))
    out = defaultdict(list)
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, visit=8.0, leaf_sample=4).orderBy(
            "query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    assert set(out) == {i for i in rows if i % 20 == 0}
    for query, found in out.items():
        wanted = exact(rows, query, 5)
        assert [s for _, s in found] == [s for _, s in wanted] or all(
            abs(a - b) < 1e-12 for (_, a), (_, b) in zip(found, wanted, strict=True))
        ties = defaultdict(set)
        for i, s in wanted:
            ties[round(s, 9)].add(i)
        last = round(wanted[-1][1], 9)
        got = defaultdict(set)
        for i, s in found:
            got[round(s, 9)].add(i)
        assert {s: v for s, v in ties.items() if s != last} == {
            s: v for s, v in got.items() if s != last}


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.1]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]),
            (4, [1.0, None]), (5, [float("inf"), 1.0]), (None, [1.0, 0.0]), (6, [1.0]),
            (7, [-1.0, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, F.col("id") % 20 == 0).collect()
    found = {(r.query_id, r.rank): r.vec_id for r in out}
    assert found == {(0, 1): 20, (0, 2): 7, (20, 1): 0, (20, 2): 7}
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_recall(spark, folder):
    rows = {r.vec_id: list(r.embedding) for r in
            spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found = defaultdict(set)
    for r in queries.op9_nearest(spark, folder).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & {i for i, _ in exact(rows, q, 5)}) for q in rows if q % 50 == 0]
    assert sum(hits) / (5 * len(hits)) >= 0.9


def test_recall_in_a_tight_group(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=64)
    tight = middle / np.linalg.norm(middle) + 0.001 * rng.normal(size=(400, 64)) / 8
    rows = {i: [float(x) for x in v] for i, v in enumerate([*tight, *rng.normal(size=(100, 64))])}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in neighbours.nearest(df, F.col("id") % 40 == 0, visit=8.0).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & {i for i, _ in exact(rows, q, 5)}) for q in rows if q % 40 == 0]
    assert sum(hits) / (5 * len(hits)) == 1.0


def test_leaves_are_split_and_read_in_blocks(spark, monkeypatch):
    """Parts of a few vectors and of a few queries, in small blocks, give the same rows."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = F.col("id") % 5 == 0
    whole = neighbours.nearest(df, asked, visit=1.0).collect()
    parts = neighbours.nearest(df, asked, visit=1.0, part_bytes=4 * 8 * 9).collect()
    assert sorted(parts) == sorted(whole) and len(whole) == 400
    join = neighbours._nearest(6, 1e-6)
    packed = neighbours._packed(np.array([v for _, v in rows]))
    vectors = pa.table({"vid": pa.array(range(400)), "unit": packed})
    queries_of = pa.table({"qid": pa.array(range(400)), "unit": packed})
    at_once = join(vectors, queries_of).sort_by([("qid", "ascending"), ("vid", "ascending")])
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 37)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 11)
    blocks = join(vectors, queries_of).sort_by([("qid", "ascending"), ("vid", "ascending")])
    assert blocks.select(["qid", "vid"]).equals(at_once.select(["qid", "vid"]))


def test_data_with_structure_opens_little():
    rng = np.random.default_rng(8)
    loose = rng.normal(size=(4000, 32))
    groups = np.repeat(rng.normal(size=(100, 32)), 40, axis=0) + 0.02 * rng.normal(size=(4000, 32))
    shares = []
    for sample in (loose, groups):
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        shares.append(neighbours.share_to_visit(neighbours.Forest(sample, 8, 32, 1), sample, 5))
    assert shares[1] < 0.2 * shares[0] <= 0.2 * 8
