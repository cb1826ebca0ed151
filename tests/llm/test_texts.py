import datetime
import hashlib
import hmac
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.samples import LONG, TEXTS, edge_documents, rows_of
from tidemark.llm import mixing, pieces, pii, queries, token_counts, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab 's'tre'll  \n\t 　é中12²Ⅷ.,!?<|endoftext|>'ve'm \r\n'D'▁<s> ﬁ"


def odd_texts(count, seed=1):
    rng = random.Random(seed)
    for n in range(count):
        size = rng.randint(0, 40)
        if n % 3:
            yield "".join(rng.choice(ALPHABET) for _ in range(size))
        else:
            yield "".join(chr(rng.choice([rng.randint(1, 0x2fff), rng.randint(0x4e00, 0x9fff),
                                          rng.randint(32, 126)])) for _ in range(size))


@pytest.fixture(scope="module")
def tokens_of():
    library = Tokenizer.from_file(BYTES)
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_token_counts_equal_the_library(tokens_of, monkeypatch):
    counter = token_counts.Counter(token_counts.load_tables(BYTES))
    texts = [*odd_texts(3000), *(t or "" for t in TEXTS), "x<|endoftext|>  <|endoftext|>y "]
    assert [counter.tokens(t) for t in texts] == [tokens_of(t) for t in texts]
    for chunk in (1, 7):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert [counter.scan(t) for t in texts[:300] if "<|end" not in t] == [
            tokens_of(t) for t in texts[:300] if "<|end" not in t]
    monkeypatch.setattr(token_counts, "KEPT_STATES", 10)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 10)
    assert [counter.tokens(t) for t in texts[:300]] == [tokens_of(t) for t in texts[:300]]


def merged(data, rank):
    """Brute force: the pair of lowest rank, leftmost first, until there is none."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False))
                    if p in rank]:
        at = min(pairs)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_transducer_equals_plain_merging():
    rng = random.Random(3)
    for _ in range(30):
        merges, tokens = [], [b"a", b"b", b"c"]
        while len(merges) < 9:  # vocabularies whose tokens encode to themselves
            pair = (rng.choice(tokens), rng.choice(tokens))
            rank = {p: n for n, p in enumerate([*merges, pair])}
            if pair not in merges and pair[0] + pair[1] not in tokens and len(
                    merged(pair[0] + pair[1], rank)) == 1:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        rank = {p: n for n, p in enumerate(merges)}
        transducer = token_counts.Transducer(merges)
        for _ in range(60):
            data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 25)))
            assert transducer.count(data) == len(merged(data, rank))


def test_chunk_maps_compose_in_any_grouping():
    counter = token_counts.Counter(token_counts.load_tables(BYTES))
    maps = [counter.chunk(t) for t in ("ab c", "d", "e  f g'", "s", " h")]
    left = maps[0]
    for m in maps[1:]:
        left = counter.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = counter.compose(m, right)
    assert left == right


def test_token_query(spark, folder, tokens_of):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in queries.op3_token_counts(spark, folder).collect():
        assert row.n_tokens == tokens_of(texts[row.doc_id])
        assert row.n_bytes == len(texts[row.doc_id].encode()) and row.over_limit == (row.n_tokens > 512)


def test_token_edges(spark, tokens_of):
    docs = edge_documents(spark)
    out = token_counts.token_counts(docs, BYTES)
    assert rows_of(out, "text", "n_tokens") == sorted(
        ((r.text, tokens_of(r.text)) for r in docs.collect()), key=repr)
    assert token_counts.token_counts(docs.limit(0), BYTES).count() == 0


def test_pieces_equal_the_library(model, monkeypatch):
    coder = pieces.Coder(pieces.load_pieces(PIECES))
    texts = [*odd_texts(3000, 2), *(t or "" for t in TEXTS), " " * 300 + "x" + " " * 77, "ab" * 999]

    def ids(text):
        return np.frombuffer(coder.encode_all([text])[0], "<i4").tolist()

    assert [ids(t) for t in texts] == model.encode(texts)
    assert [coder.decode(ids(t)) for t in texts] == [model.decode(model.encode(t)) for t in texts]
    packed = coder.encode_all(texts)
    assert [np.frombuffer(p, "<i4").tolist() for p in packed] == model.encode(texts)
    monkeypatch.setattr(pieces, "STRIDE", 30)
    assert [ids(t) for t in texts] == model.encode(texts)


def test_decoding_any_ids_equals_the_library(model):
    coder = pieces.Coder(pieces.load_pieces(PIECES))
    rng = random.Random(8)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randint(259, 31999)])
               for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == model.decode(ids)


def test_piece_query_and_edges(spark, folder, model):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in queries.op5_sentencepiece(spark, folder).collect():
        ids = model.encode(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert row.decoded_sha256 == sha(model.decode(ids))
    docs = edge_documents(spark)
    one = pieces.round_trip(docs, PIECES)
    two = pieces.decoded(pieces.encoded(docs, PIECES), PIECES)
    assert rows_of(one, "doc_id", "ids", "decoded") == rows_of(two, "doc_id", "ids", "decoded")
    assert all(r.ids == model.encode(r.text or "") for r in one.collect())
    assert pieces.round_trip(docs.limit(0), PIECES).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(n, f"s{n % 5}" if n % 17 else None, "w " * rng.randint(0, 40)) for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in out)
    by_source = defaultdict(list)
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        by_source[r.source].append(r)
    assert abs(sum(rs[0].target for rs in by_source.values()) - 1.5 * total) < 1e-6 * total
    for rs in by_source.values():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert rs[0].target <= 2 * rs[0].source_size + 1e-9
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 40
    again = mixing.mix_sources(docs.repartition(9)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in out}


def test_targets_by_repeated_sharing(spark):
    """Brute force: share, stop at the bound, share the excess, until none is above."""
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 400, "e": 0, None: 70}
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else unit * weight[s]
            left -= target[s]
        open_ -= full or open_
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(sized, (3, 1, 2), 1.5, 2.0).collect()}
    assert found == pytest.approx(target)


def test_mix_edges(spark):
    docs = edge_documents(spark)
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    same = {(r.copies, r.target) for r in out.filter("doc_id = 0").collect()}
    assert len(same) == 1
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    assert mix.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.filter("text = ''")).first().taken == 0


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    rows = ["card 4111 1111 1111 1111.", "4111-1111-1111-1111 and 4111111111111112",
            "call +1 (017) 555-7713, 212-555-0100", "123-45-6789 or 000-12-3456 or 666-12-3456",
            "97.51.17.173 but 256.1.1.1", "1999-02-28 but 1999-02-30 and 2100-01-01",
            "write die.55@mail4.example.com!", "378282246310005"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    first = "".join(c for c in out[0].pseudonymised if c.isdigit())
    second = "".join(c for c in out[1].pseudonymised.split(" and ")[0] if c.isdigit())
    assert first == second != "4111111111111111" and luhn(first) and len(first) == 16
    assert out[1].pseudonymised.endswith("and 4111111111111112") and out[1].n_cards == 1
    assert out[2].n_phones == 2 and "555-7713" not in out[2].pseudonymised
    assert out[2].pseudonymised.startswith("call +1 (")
    assert out[3].n_social == 1 and out[3].pseudonymised.endswith("or 000-12-3456 or 666-12-3456")
    assert out[4].n_addresses == 1 and out[4].pseudonymised.endswith("but 256.1.1.1")
    assert out[5].n_dates == 1 and out[5].pseudonymised.endswith("1999-02-30 and 2100-01-01")
    assert out[6].n_emails == 1 and out[6].pseudonymised.endswith("@mail4.example.com!")
    amex = out[7].pseudonymised
    assert luhn(amex) and len(amex) == 15
    other = pii.pseudonymise(docs, "another key").filter("doc_id = 7").first().pseudonymised
    assert other != amex


def test_pseudonyms_beside_signs_and_letters(spark):
    rows = {"(joe@mail.com)": "emails", "-joe@mail.com": "emails", "/joe@mail.com": "emails",
            "(10.0.0.1)": "addresses", "http://10.0.0.1/x": "addresses", "-10.0.0.1-": "addresses",
            "10.0.0.1:80x": "addresses", "(1999-02-03)": "dates", "/1999-02-03/": "dates",
            "2024-01-02T10:00:00Z": "dates", "x.2024-01-02-7": "dates",
            "(4111111111111111)": "cards", "No.4111111111111111x": "cards",
            "/4111-1111-1111-1111/": "cards", "(123-45-6789)": "social", "+123-45-6789a": "social",
            "(555-123-4567)": "phones", "555 123 4567": "phones", "+1 555 123 4567": "phones",
            "1-555-123-4567x89": "phones", "tel:(555) 123 4567,": "phones"}
    stay = ["1.2.3.4.5", "v1.2.3.4", "11999-02-03", "0.4111111111111111", "1123-45-6789", "1555 123 4567"]
    docs = spark.createDataFrame([(t,) for t in [*rows, *stay]], "text string")
    out = {r.text: r for r in pii.pseudonymise(docs, "k").collect()}
    for text, kind in rows.items():
        found = {k for k in pii.KINDS for _ in range(out[text][f"n_{k}"])}
        assert (found, sum(out[text][f"n_{k}"] for k in pii.KINDS)) == ({kind}, 1), text
        assert out[text].pseudonymised != text
    assert all(out[text].pseudonymised == text for text in stay)
    assert out["2024-01-02T10:00:00Z"].pseudonymised.endswith("T10:00:00Z")
    assert out["(joe@mail.com)"].pseudonymised.endswith("@mail.com)")


def test_cards_beside_further_digits(spark):
    card = "4111 1111 1111 1111"
    rows = [f"{card} 05/27", "4111111111111111 123 x", f"{card} 123", f"05/27 {card}", f"12-27 {card} 9",
            f"{card} 378282246310005", f"{card} 2024-01-02", f"{card} 123-45-6789", f"{card} 10.0.0.1",
            f"{card} 212-555-0100", f"{card} 55joe@mail.com", f"{card}-05-27", " 7" * 9000 + f" {card}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "n int, text string")
    out = {r.n: r for r in pii.pseudonymise(docs, "k").collect()}
    moved = pii.pseudonymise(docs.limit(0).union(spark.createDataFrame([(0, card)], docs.schema)),
                             "k").first().pseudonymised
    plain = moved.replace(" ", "")
    assert luhn(plain)
    assert out[0].pseudonymised == f"{moved} 05/27" and out[1].pseudonymised == f"{plain} 123 x"
    assert out[2].pseudonymised == f"{moved} 123" and out[3].pseudonymised == f"05/27 {moved}"
    assert out[4].pseudonymised == f"12-27 {moved} 9" and out[5].n_cards == 2
    assert [out[n][f"n_{k}"] for n, k in ((6, "dates"), (7, "social"), (8, "addresses"), (9, "phones"),
                                          (10, "emails"))] == [1] * 5
    assert all(out[n].n_cards == 1 and out[n].pseudonymised.startswith(moved) for n in range(6, 12))
    assert "1111 1111" not in out[12].pseudonymised and out[12].n_cards > 0


def test_permutations_are_permutations(spark):
    for low, high in ((10, 10), (17, 30), (4, 25)):
        every = spark.range(low * high).select(pii.permuted(F.col("id"), low, high, "k", "t"))
        assert sorted(r[0] for r in every.collect()) == list(range(low * high))
    days = spark.range(pii.DAYS).select(F.date_format(F.date_add(
        F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    sample = days.filter("hash(text) % 40 = 0")
    moved = pii.pseudonymise(sample, "k")
    assert moved.select("pseudonymised").distinct().count() == sample.count()
    assert moved.agg(F.sum("n_dates")).first()[0] == sample.count()


def test_pseudonym_edges(spark):
    docs = edge_documents(spark)
    out = pii.pseudonymise(docs, "k")
    assert rows_of(out, "doc_id", "pseudonymised") == rows_of(docs, "doc_id", "text")
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0
    plan = queries.op7_pseudonyms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "a key that the caller keeps" not in plan


def moved_in_python(value, low, high, key, tag):
    """The keyed rounds over the two halves, one number at a time."""
    sub = hmac.new(key.encode(), tag.encode(), hashlib.sha256).hexdigest()
    high_half, low_half = divmod(value, low)
    for turn in range(1, pii.ROUNDS + 1):
        other = low_half if turn % 2 else high_half
        inner = hashlib.sha256(f"{sub}:{turn}:{other}".encode()).hexdigest()
        number = int(hashlib.sha256(f"{sub}|{inner}".encode()).hexdigest()[:15], 16)
        if turn % 2:
            high_half = (high_half + number % high) % high
        else:
            low_half = (low_half + number % low) % low
    return high_half * low + low_half


def in_pattern(digits, pattern):
    left = iter(digits)
    return "".join(next(left) if c.isascii() and c.isdigit() else c for c in pattern)


def other_find(text, at):
    """(kind, end) of a find that begins here and is no card; kind None where it is not valid."""
    before = text[at - 1:at]
    mail = re.compile(r"[A-Za-z0-9][\w.%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(\.[A-Za-z0-9-]{1,63}){1,4}",
                      re.ASCII).match(text, at)
    if mail and not re.match("[A-Za-z0-9]", before):
        return "emails", mail.end()
    if re.match("[0-9]", before):
        return None
    for form in (r"(\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
                 r"(\+1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"):
        phone = re.compile(form, re.ASCII).match(text, at)
        if phone:
            return "phones", phone.end()
    social = re.compile(r"(\d{3})-(\d\d)-(\d{4})(?!\d)", re.ASCII).match(text, at)
    if social and social[1] not in ("000", "666") and social[1] < "900" and social[2] != "00" \
            and social[3] != "0000":
        return "social", social.end()
    dotted = re.compile(r"\d+\.\d+\.\d+\.\d+(?!\d|\.\d)", re.ASCII).match(text, at)
    if dotted and all(int(p) < 256 and str(int(p)) == p for p in dotted[0].split(".")) \
            and not re.search(r"(\d\.|(^|[^A-Za-z])[vV])$", text[max(0, at - 2):at], re.ASCII):
        return "addresses", dotted.end()
    day = re.compile(r"(19|20)\d\d-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?!\d)", re.ASCII).match(text, at)
    if day:
        try:
            datetime.date.fromisoformat(day[0])
        except ValueError:
            return None, day.end()
        return "dates", day.end()
    return None


def card_end(text, at):
    """Where the longest valid card that begins here ends."""
    ends, place = [], at
    while len(ends) < 19:
        group = re.compile("[0-9]{1,19}(?![0-9])").match(text, place)
        if not group or (ends and other_find(text, place)):
            break
        ends.append(group.end())
        if text[group.end():group.end() + 1] not in (" ", "-"):
            break
        place = group.end() + 1
    for end in reversed(ends):
        digits = re.sub("[ -]", "", text[at:end])
        if 13 <= len(digits) <= 19 and luhn(digits):
            return end
    return None


def replaced(kind, found, key):
    digits = re.sub("[^0-9]", "", found)
    if kind == "cards":
        size = len(digits) - 1
        low = 10 ** (size // 2)
        body = str(moved_in_python(int(digits[:-1]), low, 10 ** size // low, key, f"card{size}")).zfill(size)
        return in_pattern(next(body + c for c in "0123456789" if luhn(body + c)), found)
    if kind == "phones":
        value = moved_in_python(int(digits[-10:]), 10 ** 5, 10 ** 5, key, "phone")
        return in_pattern(digits[:-10] + str(value).zfill(10), found)
    if kind == "social":
        area, group, serial = map(int, found.split("-"))
        areas = [n for n in range(1, 900) if n != 666]
        value = moved_in_python((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 99 * 9999, 898,
                                key, "social")
        rest, serial = divmod(value, 9999)
        return f"{areas[rest // 99]:03}-{rest % 99 + 1:02}-{serial + 1:04}"
    if kind == "addresses":
        value = moved_in_python(int.from_bytes(map(int, found.split("."))), 1 << 16, 1 << 16, key, "address")
        return ".".join(map(str, value.to_bytes(4)))
    if kind == "dates":
        first = datetime.date(1900, 1, 1)
        value = (datetime.date.fromisoformat(found) - first).days
        return str(first + datetime.timedelta(moved_in_python(value, 17, pii.DAYS // 17, key, "date")))
    sub = hmac.new(key.encode(), b"email", hashlib.sha256).hexdigest()
    digest = hashlib.sha256(f"{sub}|{found.lower()}".encode()).hexdigest()[:12]
    return digest.translate(str.maketrans("0123456789", "ghijklmnop")) + "@" + found.split("@")[1]


def test_pseudonyms_against_a_scan_in_python(spark):
    rng = random.Random(8)
    parts = ["4111 1111 1111 1111", "378282246310005", "212-555-0100", "(212) 555 0100", "123-45-6789",
             "10.0.0.1", "1.2.3.4.5", "1999-02-28", "1999-02-30", "jo.e@x-mail.com", "12 34", "7", "x", "v1",
             "a" * 70, "05/27", "666-12-3456", "300.1.1.1", "4111111111111112"]
    mixed = ["".join(rng.choice(parts) + rng.choice([" ", "-", ", ", ".", "\n", "", "("])
                     for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(-n, t) for n, t in enumerate(mixed, 1)], "doc_id long, text string"))
    found_kinds = set()
    for row in pii.pseudonymise(docs, "k").collect():
        text, out, counts, at, copied = row.text, [], dict.fromkeys(pii.KINDS, 0), 0, 0
        for start in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]|(?<![0-9])[0-9]|[(+]", text or ""):
            at = start.start()
            if at < copied:
                continue
            find = other_find(text, at)
            end = None
            if find is None and text[at] in "0123456789" and not re.search(
                    "[0-9][.]$", text[max(0, at - 2):at]):
                end = card_end(text, at)
                find = ("cards", end) if end else None
            if find:
                kind, end = find
                found = text[at:end]
                out += [text[copied:at], replaced(kind, found, "k") if kind else found]
                copied = end
                if kind:
                    counts[kind] += 1
                    found_kinds.add(kind)
        out.append((text or "")[copied:])
        assert "".join(out) == (row.pseudonymised or ""), text
        assert {k: row[f"n_{k}"] for k in pii.KINDS} == counts, text
    assert found_kinds == set(pii.KINDS)


@pytest.mark.parametrize("rows", [6, 40, 400])
def test_fit_of_separable_labels(rows):
    rng = np.random.default_rng(rows)
    for _ in range(30):
        y = (np.arange(rows) % 5 == 0).astype(int)
        x = np.column_stack([np.ones(rows), 9 * y + rng.integers(0, 3, rows), *(
            y * rng.random(rows) for _ in range(3)), np.zeros(rows)])
        w = toxicity._logistic(x, y)
        assert np.isfinite(w).all() and ((x @ w > 0) == y).all()
        mixed = rng.permutation(y)
        w = toxicity._logistic(x, mixed)
        p = 1 / (1 + np.exp(-(x @ w)))
        share = np.where(mixed == 1, 0.5 / mixed.mean(), 0.5 / (1 - mixed.mean()))
        assert abs(share @ (p - mixed)) < 1e-3 * rows  # the top in the unpenalized weight


def relettered(text, rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return text.lower().translate(str.maketrans(letters, "".join(rng.sample(letters, 26))))


def test_decisions_on_varied_vocabularies(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL")
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id").select(
        "doc_id", "text", "toxic").orderBy("doc_id").collect()
    for seed in (1, 2):
        ways = [random.Random(10 * seed + n) for n in range(2)]
        states = [w.getstate() for w in ways]
        texts = []
        for n, r in enumerate(rows):
            ways[n % 2].setstate(states[n % 2])  # one lettering a vocabulary
            texts.append((relettered(r.text or "", ways[n % 2]), r.toxic, crc32(str(r.doc_id).encode()) % 5))
        known = [(t, y) for t, y, fold in texts if fold]
        scorer = toxicity.Scorer(toxicity.fit(known, 0.1))
        held = [(scorer.score(t) >= 0.5, y) for t, y, fold in texts if not fold]
        assert np.mean([p for p, y in held if y]) >= 0.85
        assert np.mean([not p for p, y in held if not y]) >= 0.95


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op6_toxicity(spark, folder)
    held = rows.join(labels, "doc_id").filter("held_out").collect()
    assert {r.held_out for r in held} == {True}
    assert all(crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    share, area = toxicity.accuracy([(r.score, r.toxic) for r in held])
    assert share > 0.97 and area > 0.95
    assert np.mean([r.predicted for r in held if r.toxic]) >= 0.9
    assert np.mean([1 - r.predicted for r in held if not r.toxic]) >= 0.95


def test_toxicity_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(n, n % 2) for n in range(9)] + [(1, None), (None, 1), (99, 7)],
                                   "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    scores = defaultdict(set)
    for r in out.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        scores[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert all(r.score < 1e-8 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_labels_never_leak(spark):
    labels = spark.createDataFrame([(n, n % 2) for n in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(400)], "doc_id long, text string")
    rows, _ = toxicity.labelled_sample(docs, labels, 1000)
    used = {int(t.split()[1]) for t, _ in rows}
    assert used == {n for n in range(400) if crc32(str(n).encode()) % 5}
    assert len(toxicity.labelled_sample(docs, labels, 20)[0]) <= 60


def test_long_text_is_scored_whole():
    rows = [(f"plain words here number {n}", 0) for n in range(200)]
    rows += [(f"plain words dreadful here {n}", 1) for n in range(200)]
    random.Random(0).shuffle(rows)
    scorer = toxicity.Scorer(toxicity.fit(rows, 0.5))
    assert scorer.margin("dreadful") > 0 == scorer.margin("plain")
    assert scorer.features(LONG + " dreadful")[1] >= scorer.margin("dreadful")
