"""Links, similarity and recommendations."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import links, similarity
from pyspark.sql import functions as F

from tidemark.operators import ordered

PAGE = "page_id LONG, page_title STRING, page_namespace INT, page_is_redirect INT"


def pages(spark):
    return spark.createDataFrame([(1, "A b", 0, 0), (2, "C+", 0, 0), (3, "D", 0, 0), (4, "E", 0, 1), (5, "F", 1, 0),
                                  *[(10 + i, f"T{i}", 0, 0) for i in range(7)]], PAGE)


def test_clicks_resolve_both_ends(spark):
    clicks = spark.createDataFrame([("A+b", "C%2B", 2), ("A+b", "C%2B", 3), ("A+b", "E", 9), ("D", None, 1),
                                    ("F", "D", 4), ("D", "A+b", None)], "prev STRING, curr STRING, n LONG")
    found = links.resolve_clicks(links.click_pairs(clicks), links.encoded_pages(pages(spark)))
    assert [tuple(r) for r in found.collect()] == [(1, 2, 5, "A b", "C+")]


def test_wide_links_and_short_pages(spark):
    rows = [("A+b", f"T{i}", 10 - i) for i in range(7)] + [("D", "T1", 5), ("D", "T0", 5), ("E", "T1", 8)]
    clicks = spark.createDataFrame(rows, "prev STRING, curr STRING, n LONG")
    direct = links.top_links(clicks, pages(spark))
    steps = links.widen_links(links.top_followed(links.resolve_clicks(
        links.click_pairs(clicks), links.encoded_pages(pages(spark)))))
    expected = {("A b", "T0", "T1", "T2", "T3", "T4"), ("D", "T0", "T1", None, None, None)}
    assert {tuple(r) for r in direct.collect()} == expected
    assert {tuple(r) for r in steps.collect()} == expected
    assert "WindowGroupLimit" in direct._jdf.queryExecution().executedPlan().toString()


def test_edges_and_translation(spark):
    raw = spark.createDataFrame([(1, 0, "D", 0), (1, 0, "E", 0), (1, 1, "D", 0), (2, 0, "F", 1)],
                                "pl_from LONG, pl_from_namespace INT, pl_title STRING, pl_namespace INT")
    edges = links.link_edges(raw, pages(spark))
    assert [tuple(r) for r in edges.collect()] == [(1, 3)]
    named = links.with_titles(edges.withColumn("score", F.lit(0.5)), pages(spark))
    assert [tuple(r) for r in named.collect()] == [("A b", "D", 0.5)]


def test_dictionary_is_dense_and_sorted(spark):
    df = spark.createDataFrame([(f"v{i % 37:02d}",) for i in range(500)] + [(None,)], "v STRING")
    found = sorted((r.v, r.id) for r in links.dictionary(df, "v").collect())
    assert found == [(f"v{i:02d}", i + 1) for i in range(37)]


def preferences(seed, users, items, heavy):
    rng = random.Random(seed)
    prefs = {(u, rng.randrange(items)) for u in range(users) for _ in range(rng.randrange(1, 8))}
    for u in range(users, users + heavy):
        prefs |= {(u, i) for i in rng.sample(range(items), items * 3 // 4)}
    return sorted(prefs)


def brute_force(prefs, measure):
    users_of = {}
    for user, item in prefs:
        users_of.setdefault(item, set()).add(user)
    total = len({u for u, _ in prefs})
    scores = {}
    for a, b in itertools.permutations(users_of, 2):
        both = len(users_of[a] & users_of[b])
        if not both:
            continue
        only_a, only_b = len(users_of[a]) - both, len(users_of[b]) - both
        if measure == "tanimoto":
            scores[a, b] = round(both / (both + only_a + only_b), 6)
        else:
            cells = [both, only_a, only_b, total - both - only_a - only_b]

            def entropy(*counts):
                return sum(c * math.log(c) for c in counts if c) - sum(counts) * math.log(sum(counts))

            statistic = 2 * (entropy(*cells) - entropy(cells[0] + cells[1], cells[2] + cells[3])
                             - entropy(cells[0] + cells[2], cells[1] + cells[3]))
            scores[a, b] = round(1 - 1 / (1 + max(statistic, 0)), 6)
    return scores


@pytest.mark.parametrize("chunk", [512, 7, 1])
@pytest.mark.parametrize("measure", ["tanimoto", "loglikelihood"])
def test_similarity_equals_brute_force(spark, chunk, measure):
    prefs = preferences(5, 40, 60, 4)
    df = spark.createDataFrame(prefs, "user_id LONG, item_id LONG")
    found = {(r.item_id, r.other_id): r.score
             for r in similarity.item_similarity(df, measure, None, chunk).collect()}
    expected = brute_force(prefs, measure)
    assert found.keys() == expected.keys()
    assert all(abs(found[p] - expected[p]) < 2e-6 for p in expected)
    assert all(0 <= s <= 1 and found[b, a] == s for (a, b), s in found.items())


def test_a_user_of_many_items(spark):
    prefs = [(0, i) for i in range(1300)] + [(1, i) for i in range(0, 1300, 2)]
    df = spark.createDataFrame(prefs, "user_id LONG, item_id LONG")
    pairs = similarity.shared_users(df)
    assert pairs.count() == pairs.select("item_a", "item_b").distinct().count() == 1300 * 1299 // 2
    assert pairs.where("shared = 2").count() == 650 * 649 // 2


def test_near_scores_keep_their_order(spark):
    """Likelihood scores that all read 1.0 are still ranked."""
    prefs = [(u, i) for u in range(4000) for i in (0, 1 + u % 2)] + [(u, 3) for u in range(1990)]
    prefs += [(u, 4) for u in range(1980)] + [(u, 5) for u in range(0, 4000, 2)] + [(u, 6) for u in range(0, 3998, 2)]
    df = spark.createDataFrame(prefs, "user_id LONG, item_id LONG").distinct()
    best = similarity.item_similarity(df, "loglikelihood", 2).where("item_id = 1").collect()
    assert [r.other_id for r in best if r.other_id in (5, 6)] and {r.other_id for r in best} <= {2, 5, 6}


def test_more_than_the_group_limit(spark):
    df = spark.range(3000).selectExpr("id % 2 AS g", "id AS v")
    top = links.top_n_per_group(df, ["g"], ["v"], 1200)
    assert top.count() == 2400 and top.agg(F.max("v")).first()[0] == 2399


def test_top_similar_items(spark):
    prefs = preferences(7, 40, 30, 2)
    df = spark.createDataFrame(prefs, "user_id LONG, item_id LONG")
    top = similarity.item_similarity(df, "tanimoto", 3).collect()
    scores = brute_force(prefs, "tanimoto")
    for item in {a for a, _ in scores}:
        best = sorted(((-s, b) for (a, b), s in scores.items() if a == item))[:3]
        assert sorted((-round(r.score, 6), r.other_id) for r in top if r.item_id == item) == best


def test_similar_items_are_cut_before_the_exchange(spark):
    df = spark.createDataFrame(preferences(7, 10, 10, 0), "user_id LONG, item_id LONG")
    plan = similarity.item_similarity(df, "tanimoto", 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def spread_preferences(seed, users=150, items=120):
    """Items whose degrees differ by powers of two, as those of pages do."""
    rng = random.Random(seed)
    prefs = set()
    for item in range(items):
        degree = max(1, min(users, int(users / (1 + item // 6) ** 1.3)))
        near = rng.randrange(users)
        prefs |= {((near + rng.randrange(2 * degree)) % users, item) for _ in range(degree)}
    return sorted(prefs)


@pytest.mark.parametrize("chunk", [512, 5])
@pytest.mark.parametrize("measure", ["tanimoto", "loglikelihood"])
def test_pruned_pairs_give_the_same_best(spark, measure, chunk):
    df = spark.createDataFrame(spread_preferences(11), "user_id LONG, item_id LONG")
    for k in (1, 4):
        every = similarity.item_similarity(df, measure, k, chunk).collect()
        assert sorted(similarity.pruned_similarity(df, measure, k, chunk).collect()) == sorted(every)


def test_pruning_counts_fewer_pairs(spark):
    df = spark.createDataFrame(spread_preferences(11), "user_id LONG, item_id LONG")
    known = similarity.described_preferences(df).withColumn("power", F.floor(F.log2("degree")).cast("int"))
    strength, score = similarity._measured(df, "tanimoto")
    like = similarity.counted_pairs(known, among=similarity._like_degrees())
    best = links.top_n_per_group(similarity._both_ways(like, strength, score), ["item_id"],
                                 [F.desc("_strength"), "other_id"], 3)
    counted = like.count() + similarity.pruned_pairs(known, best, "tanimoto", 150, 3).count()
    assert counted < 0.8 * similarity.shared_users(df).count()


@pytest.mark.parametrize("measure", ["tanimoto", "loglikelihood"])
def test_no_pair_is_stronger_than_its_bound(spark, measure):
    df = spark.createDataFrame([(s, a, b) for a in range(1, 13) for b in range(1, 13)
                                for s in range(max(1, a + b - 12), min(a, b) + 1)],
                               "shared LONG, degree_a LONG, degree_b LONG")
    users = F.lit(12)
    numbers = [F.col(c) for c in df.columns]
    real = (similarity.tanimoto(*numbers) if measure == "tanimoto"
            else similarity.likelihood_ratio(*numbers, users))
    bound = similarity.strongest_possible(measure, F.col("degree_a"), F.col("degree_b"), users)
    assert df.where(real > bound + 1e-9).count() == 0


def test_recommendations_are_new_and_ranked(spark):
    prefs = preferences(3, 30, 40, 1)
    df = spark.createDataFrame(prefs, "user_id LONG, item_id LONG")
    similar = similarity.item_similarity(df, "tanimoto", 10)
    listed = spark.createDataFrame([(u,) for u in range(10)], "user_id LONG")
    found = similarity.recommend_items(df, similar, 4, listed).collect()
    sims = {}
    for r in similar.collect():
        sims.setdefault(r.item_id, {})[r.other_id] = r.score
    for user in range(10):
        own = {i for u, i in prefs if u == user}
        sums = {}
        for i in own:
            for other, score in sims.get(i, {}).items():
                sums[other] = sums.get(other, 0) + score
        best = sorted((-round(s, 12), i) for i, s in sums.items() if i not in own)[:4]
        assert sorted((-r.score, r.item_id) for r in found if r.user_id == user) == best
    assert {r.user_id for r in found} <= set(range(10))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_PAIRS", 1000), ("HEAVY_ITEM", 12), ("BLOCK_PREFERENCES", 40),
                        ("SUMS_AT_ONCE", 100), ("HEAVY_USER", 30)):
        monkeypatch.setattr(similarity, name, value)


@pytest.mark.parametrize("measure", ["tanimoto", "loglikelihood"])
@pytest.mark.parametrize("chunk", [512, 7])
def test_similarity_in_blocks_equals_brute_force(spark, small_blocks, measure, chunk):
    """Blocks of items, users of several chunks, and items of too many users for one task."""
    prefs = preferences(5, 40, 60, 4)
    df = spark.createDataFrame([*prefs, (None, 3), (2000, None)], "user_id LONG, item_id LONG")
    plain = spark.createDataFrame(prefs, "user_id LONG, item_id LONG")
    found = {(r.item_id, r.other_id): r.score
             for r in similarity.item_similarity(plain, measure, None, chunk).collect()}
    expected = brute_force(prefs, measure)
    assert found.keys() == expected.keys()
    assert all(abs(found[p] - expected[p]) < 2e-6 for p in expected)
    for k in (3, 1200):
        rows = sorted(similarity.item_similarity(df, measure, k, chunk).collect())
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(similarity, "BLOCK_PAIRS", 1 << 40)
            assert rows == sorted(similarity.item_similarity(df, measure, k, chunk).collect())


def test_pairs_are_not_exchanged(spark, monkeypatch):
    """What is moved are lists of items: neither pairs nor the similar items meet an exchange."""
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 1000)
    df = spark.createDataFrame(preferences(7, 40, 60, 4), "user_id LONG, item_id LONG")
    plan = similarity.item_similarity(df, "tanimoto", 10)._jdf.queryExecution().executedPlan().toString()
    assert "other_id" in plan and plan.count("Exchange") == 2
    assert plan.rindex("Generate inline") < plan.index("Exchange")


def test_recommendations_in_blocks(spark, small_blocks):
    """Small blocks, few sums at once and users of too many items for one task change nothing."""
    prefs = preferences(3, 30, 40, 3)
    df = spark.createDataFrame([*prefs, (None, 4), (None, 8)], "user_id LONG, item_id LONG")
    similar = spark.createDataFrame(
        [(a, b, 1.0 / (1 + (a * 7 + b) % 9)) for a in range(0, 40, 2) for b in range(40, 3, -3) if a != b],
        "item_id LONG, other_id LONG, score DOUBLE")
    exact = links.top_n_per_group(similarity._summed(df, similar, 12), ["user_id"],
                                  [F.desc("score"), "item_id"], 4, "rank")
    found = similarity.recommend_items(df, similar, 4)
    assert found.columns == ["user_id", "item_id", "score", "rank"]
    assert sorted(found.collect(), key=str) == sorted(exact.collect(), key=str)
    assert found.where("user_id IS NULL").count() == 4


def test_packed_lists_come_back():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(-50, 1 << bits, n)) for bits, n in ((5, 1), (20, 60), (62, 9), (9, 700), (40, 3))]
    ids = np.concatenate(lists)
    degrees = rng.integers(1, 1 << 40, len(ids))
    opens = np.cumsum([0] + [len(x) for x in lists[:-1]])
    packed = similarity._items_packed(ids, degrees, opens)
    column = pa.chunked_array([packed.slice(0, 2), packed.slice(2)])
    found, found_degrees, sizes = similarity._items_unpacked(column)
    assert (found == ids).all() and (found_degrees == degrees).all()
    assert sizes.tolist() == [len(x) for x in lists]


def test_similar_rows_come_back_with_few_bytes():
    rng = np.random.default_rng(2)
    rows = [(i, int(o), 1 / (2 + int(o) % 7)) for i in range(20) for o in rng.choice(20000, 100, replace=False)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["item_id", "other_id", "score"])
    packed = pa.Table.from_batches(list(similarity._pack_similar([batch.slice(0, 950), batch.slice(950)])))
    others, scores, sizes = similarity._similar_unpacked(packed)
    listed = np.repeat(packed["item_id"].to_numpy(), sizes)
    assert sorted(zip(listed.tolist(), others.tolist(), scores.tolist())) == sorted(rows)
    assert packed.num_rows == 21 and packed.nbytes < 5 * len(rows)


def test_lists_of_items_are_packed_for_their_blocks(spark):
    """Sixty items of twenty thousand cost some three bytes each and block."""
    rng = random.Random(4)
    rows = [(u, i, 30, i // 500) for u in range(40) for i in rng.sample(range(20000), 60)]
    placed = spark.createDataFrame(rows, "user_id LONG, item_id LONG, degree LONG, block INT")
    lists = similarity.listed_items(placed, None, 512)
    assert dict(lists.dtypes)["others"] == "binary"
    assert lists.agg(F.max(F.length("others"))).first()[0] < 4 * 60
    assert lists.count() == len({(u, b) for u, _, _, b in rows})


@pytest.mark.parametrize("measure", ["tanimoto", "loglikelihood"])
def test_an_item_of_many_pairs_is_added_up_in_parts(spark, monkeypatch, measure):
    prefs = preferences(5, 40, 60, 4)
    df = spark.createDataFrame(prefs, "user_id LONG, item_id LONG")
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 1000)
    found = []
    for at_once in (1 << 21, 50, 1):
        monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", at_once)
        found.append(sorted(similarity.item_similarity(df, measure, 7).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 300


def test_recommendations_are_ranked_where_they_are_summed(spark):
    df = spark.createDataFrame(preferences(3, 30, 40, 1), "user_id LONG, item_id LONG")
    similar = spark.createDataFrame([(a, b, 0.5) for a in range(40) for b in range(a)],
                                    "item_id LONG, other_id LONG, score DOUBLE")
    plan = similarity.recommend_items(df, similar, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("FlatMapCoGroupsInArrow")]


def test_similar_rows_of_an_item_need_not_come_together(spark):
    df = spark.createDataFrame(preferences(3, 30, 40, 1), "user_id INT, item_id INT")
    similar = spark.createDataFrame([(a, b, 1.0 / (1 + (a + b) % 5)) for a in range(40) for b in range(40) if a != b],
                                    "item_id INT, other_id INT, score DOUBLE")
    apart = similar.orderBy("other_id").repartition(7, "other_id")
    found = similarity.recommend_items(df, apart, 4)
    assert found.dtypes == [("user_id", "int"), ("item_id", "int"), ("score", "double"), ("rank", "int")]
    exact = links.top_n_per_group(similarity._summed(df, similar, 12), ["user_id"],
                                  [F.desc("score"), "item_id"], 4, "rank")
    assert sorted(found.collect()) == sorted(exact.collect())


@pytest.fixture
def narrow_slices(monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_WIDTH", 4)


def test_rank_with_one_dominant_key(spark, narrow_slices):
    rows = [("hot", i * 7 % 5000) for i in range(5000)] + [("cold", i) for i in range(20)] + [(None, 3), (None, 1)]
    df = spark.createDataFrame(rows, "k STRING, o LONG")
    expected = {}
    for key in ("hot", "cold", None):
        for place, o in enumerate(sorted(o for k, o in rows if k == key), 1):
            expected[key, o] = place
    assert {(r.k, r.o): r.r for r in ordered.rank_rows(df, ["k"], ["o"], "r").collect()} == expected
    assert ordered.rank_rows(df, [], ["o", "k"], "r").agg(F.max("r")).first()[0] == len(rows)
    spread = ordered.cut_by_order(df, ["k"], ["o"], 8).groupBy("_slice").count().collect()
    assert max(r["count"] for r in spread) < 2000


def test_running_totals_and_next_position(spark, narrow_slices):
    rows = [("a", p, p % 3) for p in (1, 2, 5, 9, 10, 40)] + [("b", 3, 7)]
    df = spark.createDataFrame(rows, "k STRING, p LONG, v LONG")
    totals, tops, expected = {}, {}, {}
    for k, p, v in rows:
        totals[k] = totals.get(k, 0) + v
        tops[k] = max(tops.get(k, 0), v)
        expected[k, p] = (totals[k], tops[k])
    for position in ("p", None):
        sums = ordered.running_totals(df, ["k"], ["p"], {"s": F.col("v")}, position=position)
        both = ordered.running_totals(sums, ["k"], ["p"], {"t": F.col("v")}, True, position)
        assert {(r.k, r.p): (r.s, r.t) for r in both.collect()} == expected
    following = ordered.next_position(df, ["k"], "p", "n")
    assert {(r.k, r.p): r.n for r in following.collect()} == {
        ("a", 1): 2, ("a", 2): 5, ("a", 5): 9, ("a", 9): 10, ("a", 10): 40, ("a", 40): None, ("b", 3): None}
