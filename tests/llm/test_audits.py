"""Quality rules, filter audit and tokenizer alignment against brute force and on odd tables."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.samples import LONG, TEXTS, edge_documents, rows_of
from tests.llm.test_texts import odd_texts
from tidemark.llm import cross_tokens, filter_audit, names, quality, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words_of(text):
    out, word = [], ""
    for c in f"{text} ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def test_spare_names():
    assert names.spare(["a", "_b", "B"], "c", "b", "B") == ["c", "__b", "___B"]


def plain_rules(text):
    words = words_of(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + n for i, w in enumerate(windows) if many[w] > 1 for n in range(3)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_rules_equal_brute_force():
    rng = random.Random(4)
    texts = [*odd_texts(500), *(t or "" for t in TEXTS), "a a a", "a a a a", "a\x1cb c\x85d e　f"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["\n".join(rng.choice(["x y", "x y ", "", " ", "\tz"]) for _ in range(9)) for _ in range(50)]
    for text in texts:
        assert quality.rules(text) == plain_rules(text), repr(text)


def plain_buckets(text):
    return [sum(ord(c) * quality.BASE ** (3 - n) for n, c in enumerate(text[i:i + 4])) % quality.BUCKETS
            for i in range(len(text) - 3)]


def test_grams_do_not_depend_on_stretches(monkeypatch):
    for text in ["", "abc", "abcd", "naïve 中文 \U0010ffff\U0010ffff\U0010ffff\U0010ffff text"]:
        whole = [int(b) for part in quality.grams(text) for b in part]
        assert whole == plain_buckets(text)
        monkeypatch.setattr(quality, "STRIDE", 3)
        assert [int(b) for part in quality.grams(text) for b in part] == whole
        monkeypatch.undo()


def test_threshold_parts_best():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.randint(-3, 3), rng.random() < 0.5, rng.randint(1, 3)) for _ in range(rng.randint(1, 9))]
        total = {k: sum(n for _, kind, n in rows if kind == k) for k in (True, False)}
        found = quality.threshold(rows)
        if not all(total.values()):
            assert found is None
            continue

        def lead(step):
            kept = {k: sum(n for s, kind, n in rows if kind == k and s >= step) for k in total}
            return kept[True] / total[True] - kept[False] / total[False]

        steps = sorted({s for s, _, _ in rows})
        assert lead(found) == max(map(lead, steps))
        assert found == min(s for s in steps if lead(s) == lead(found))


def test_quality_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.1"
    judged = queries.op11_quality_rules(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = judged.filter("NOT base_failed").join(labels, "doc_id").collect()
    share = {k: np.mean([r.kept for r in rows if r.quality == k]) for k in (0, 1)}
    assert share[1] > 0.98 and share[0] < 0.05


def test_quality_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(0, 1), (4, 0), (6, 0), (None, 1), (0, 1), (77, 0), (2, None)],
                                   "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        out = quality.quality(docs, given)
        assert set(docs.columns) - {"text"} <= set(out.columns) and out.count() == docs.count()
        found = sorted(tuple(r) for r in out.select(*list(quality.ADDED)[:6]).collect())
        assert found == sorted(plain_rules(r.text or "") for r in docs.collect())
    assert out.filter("NOT kept AND NOT base_failed").count() == 0
    assert {r.score for r in out.collect()} == {0}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_trie_numbers_texts():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    texts += [LONG.encode(), LONG.encode()[:-1], LONG.encode() + b"z"] * 2
    trie, number = filter_audit.Trie(), {}
    for text in texts:
        assert trie.insert(text) == number.setdefault(text, len(number))
    assert trie.size == len(number)


def plain_audit(docs, labels):
    """Brute force: every order applied to every document."""
    least, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for key, _, text in docs:
        if key is not None and key < least.get(text or "", key + 1):
            least[text or ""] = key
    for key, q, t in labels:
        good[key] |= q == 1
        toxic[key] |= t == 1
    failed = []
    for key, part, text in docs:
        text = text or ""
        words = words_of(text)
        hit = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
               "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
               "D": any(c in "#$%&*|" for c in text),
               "E": text in least and (key is None or least[text] < key)}
        failed.append((part or "", {f for f, h in hit.items() if h}, key is not None and good[key],
                       key is not None and toxic[key]))
    rows = {}
    for part in {p for p, *_ in failed}:
        own = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                shapley[letter] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone),
                    sum(letter in f[1] and bool(f[1] & set(order[:step - 1])) for f in own),
                    sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


@pytest.mark.parametrize("buffer, partition", [(1, 200), (5000, 1000), (1 << 25, 1 << 24)])
def test_audit_equals_brute_force(spark, monkeypatch, buffer, partition):
    monkeypatch.setattr(filter_audit, "BUFFER", buffer)
    monkeypatch.setattr(filter_audit.by_prefix, "__defaults__", (partition,))
    rng = random.Random(6)
    start = "the same long beginning of many texts, " * 9
    pool = [*TEXTS, start, start + "a", start + "b", "A" * 300, "x # y", *odd_texts(40)]
    docs = [(rng.choice([None, *range(300)]), rng.choice([None, "", "en", "fr"]), rng.choice(pool))
            for _ in range(500)] + [(n, "en", start) for n in range(200, 400)]
    labels = [(rng.choice([None, *range(300)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]))
              for _ in range(300)]
    out = filter_audit.filter_audit(
        spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert found == plain_audit(docs, labels)


def test_audit_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    out = filter_audit.filter_audit(docs, labels)
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert found == plain_audit(rows, [(0, 1, 1)])
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


@pytest.fixture(scope="module")
def tables():
    return cross_tokens.load(BYTES, PIECES)


@pytest.fixture(scope="module")
def plain_align(tables):
    """Brute force with the plain libraries on the whole text."""
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def align(text):
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        data = f" {text}".encode()
        sides = [(a, tables["first"]), (b, tables["second"])]
        if any(b"".join(v[i] for i in ids) != data for ids, v in sides):
            return 0, 0, [], ""
        ends = [list(np.cumsum([len(v[i]) for i in ids])) for ids, v in sides]
        groups, links, before = [], [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            inside = [[i for e, i in zip(es, ids, strict=True) if before < e <= cut]
                      for es, (ids, _) in zip(ends, sides, strict=True)]
            groups.append("|".join(",".join(map(str, ids)) for ids in inside))
            links.append((inside[0][-1], inside[1][-1]))
            before = cut
        return len(a), len(b), links, ";".join(groups)
    return align


def test_alignment_equals_the_libraries(tables, plain_align, monkeypatch):
    texts = [*odd_texts(2500), *(t or "" for t in TEXTS if t != LONG), " ", "  ", "a ", "a  ", " a", "\n", "a\n b",
             "a \n", "▁", "a▁b c", "<s>x</s>", "<|endoftext|> x", "z" * 900, "é" * 900, "a\x1c b", "a\x85 b\xa0 c"]
    size = len(tables["second"])
    aligner = cross_tokens.Aligner(tables)
    for kept in (cross_tokens.KEPT_UNITS, 5):
        monkeypatch.setattr(cross_tokens, "KEPT_UNITS", kept)
        for start in range(0, len(texts), 300):
            part = texts[start:start + 300]
            for text, (n_a, n_b, links, groups) in zip(part, aligner.align(part), strict=True):
                keys = tables["keys"][np.frombuffer(links, "<i4")].tolist()
                assert (n_a, n_b, [(k // size, k % size) for k in keys],
                        groups.decode()) == plain_align(text), repr(text)


def plain_measures(texts, plain_align):
    """Measures of all texts, copies counted as often as they stand."""
    aligned = [plain_align(t or "") for t in texts]
    counts = Counter(pair for _, _, links, _ in aligned for pair in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for n_a, n_b, links, g in aligned]


def test_cross_token_query(spark, folder, plain_align):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([r.doc_id for r in docs],
                        plain_measures([r.text for r in docs], plain_align), strict=True))
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13_cross_tokens(spark, folder).collect()}
    assert found == expected


def test_cross_token_edges(spark, plain_align, monkeypatch):
    docs = edge_documents(spark).filter("length(coalesce(text, '')) < 1000")
    for share in (cross_tokens.SHARE, 0.4):
        monkeypatch.setattr(cross_tokens, "SHARE", share)
        out = cross_tokens.align_tokenizers(docs, BYTES, PIECES)
        rows = docs.collect()
        expected = plain_measures([r.text for r in rows], plain_align)
        assert rows_of(out, "doc_id", "text", *cross_tokens.MEASURES) == sorted(
            ((r.doc_id, r.text, *m) for r, m in zip(rows, expected, strict=True)), key=repr)
        assert set(docs.columns) <= set(out.columns)
    assert cross_tokens.align_tokenizers(docs.limit(0), BYTES, PIECES).count() == 0
    whole = edge_documents(spark).filter("length(text) > 1000")
    assert cross_tokens.align_tokenizers(whole, BYTES, PIECES).first().n_groups > 60_000
