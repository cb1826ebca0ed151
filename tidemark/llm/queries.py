"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat,
    cross_tokens,
    exact_dedup,
    filter_audit,
    line_dedup,
    mixing,
    neighbours,
    pieces,
    pii,
    quality,
    simhash,
    token_counts,
    toxicity,
)
from tidemark.plans.views import table

TRICKY = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all formatted conversations, read back from the output."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"))
    formatted = chat.format_conversations(rows.unionByName(added))
    turns = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = chat.loss_text(F.col("segments"))
    return formatted.select(
        "conv_id", F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), measured AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS earlier,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS later,
    5 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE NULL END
    + 1 + length(text) + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda run: length(run) - 2)), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 8 AS chars
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN earlier IS NULL AND later IS NOT NULL
    WHEN 'user' THEN (earlier IS NULL OR earlier IN ('system', 'assistant')) AND later IS NOT NULL
    WHEN 'assistant' THEN earlier IS NOT NULL AND earlier = 'user' ELSE FALSE END) AS valid
FROM measured GROUP BY conv_id
"""


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is cut of every document, and a digest of what stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(
        "doc_id", "removed_lines", "removed_words",
        F.sha2(F.coalesce("deduped", F.lit("")), 256).alias("deduped_sha256"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS bound,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (
        ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, CASE WHEN bound / weight > level
    THEN max(level) FILTER (bound / weight > level) OVER () * weight ELSE bound END AS target
  FROM levels
), expected AS (
  SELECT doc_id, size, t.*, u, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS e
  FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, floor(e) AS whole, CASE WHEN e > floor(e)
    THEN u / (1 - u) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank
  FROM expected
), summed AS (
  SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source
      ORDER BY rank NULLS LAST, coalesce(doc_id::VARCHAR, '')) AS until,
    sum(size) OVER (PARTITION BY source, rank, doc_id) AS here,
    target - sum(whole * size) OVER (PARTITION BY source) AS remaining
  FROM ranked
)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN rank IS NOT NULL AND until - here / 2 <= remaining THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the pieces of every document, and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _piece_digests(pieces.round_trip(docs, model))


def _piece_digests(coded: DataFrame) -> DataFrame:
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         "score", "predicted")


def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced, and what was found."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, "a key that the caller keeps")
    return found.drop("text")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays, and the group's size, for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest others of every fiftieth vector."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("id") % 50 == 0)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counted rules and the verdict of the likelihood ratio for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.quality(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "score", "kept")


OP11_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: unicode(c)::BIGINT) AS codes
  FROM documents
), known AS (
  SELECT doc_id, min(quality) = 1 AS trusted FROM labels
  WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id
), windows AS (
  SELECT r, len(words) AS size, unnest(range(1, len(words) - 1)) AS place,
    unnest(list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS three
  FROM texts WHERE len(words) > 2
), twice AS (
  SELECT r, place FROM (SELECT *, count(*) OVER (PARTITION BY r, three) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT place + step) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) steps(step) GROUP BY r
), ruled AS (
  SELECT t.r, t.doc_id, len(words)::BIGINT AS n_words,
    length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(c.n_repeat_words, 0) AS n_repeat_words, trusted
  FROM texts t LEFT JOIN covered c USING (r) LEFT JOIN known k ON t.doc_id = k.doc_id
), grams AS (
  SELECT r, unnest(list_transform(range(1, len(codes) - 2), lambda i:
    (codes[i] * 496604932559 + codes[i + 1] * 62710561 + codes[i + 2] * 7919 + codes[i + 3]) % 65521)) AS bucket
  FROM texts
), held AS (
  SELECT r, bucket, count(*) AS n FROM grams GROUP BY ALL
), counted AS (
  SELECT bucket, sum(n)::DOUBLE AS n, coalesce(sum(n) FILTER (trusted), 0)::DOUBLE AS trusted_n
  FROM held JOIN ruled USING (r) GROUP BY bucket
), weights AS (
  SELECT bucket, CASE WHEN sum(trusted_n) OVER () = 0 THEN 0 ELSE
    round((ln((trusted_n + 1) / (sum(trusted_n) OVER () + 65521))
         - ln((n + 1) / (sum(n) OVER () + 65521))) * 1000000) END::BIGINT AS weight
  FROM counted
), scored AS (
  SELECT r, floor(sum(n * weight)::DOUBLE / sum(n))::BIGINT AS score
  FROM held JOIN weights USING (bucket) GROUP BY r
), judged AS (
  SELECT ruled.* EXCLUDE (r), coalesce(score, 0) AS score,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    floor(coalesce(score, 0) / 1000.0)::BIGINT AS step
  FROM ruled LEFT JOIN scored USING (r)
), steps AS (
  SELECT step, count(*) FILTER (trusted) AS good, count(*) FILTER (NOT trusted) AS bad
  FROM judged WHERE NOT base_failed AND trusted IS NOT NULL GROUP BY step
), shares AS (
  SELECT step, sum(good) OVER up / (sum(good) OVER ())::DOUBLE
    - sum(bad) OVER up / (sum(bad) OVER ())::DOUBLE AS lead
  FROM steps WINDOW up AS (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), bound AS (
  SELECT first(step ORDER BY lead DESC, step) AS least FROM shares
  HAVING (SELECT sum(good) > 0 AND sum(bad) > 0 FROM steps)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
  NOT base_failed AND coalesce(step >= (SELECT least FROM bound), TRUE) AS kept
FROM judged
"""


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.filter_audit(docs, labels)


OP12_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || letter FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) letters(letter)
  WHERE NOT contains(filter_order, letter)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
    substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (VALUES (1), (2), (3), (4), (5)) numbers(step) WHERE length(filter_order) = 5
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    coalesce(doc_id IS NULL AND min(doc_id) OVER same IS NOT NULL OR doc_id > min(doc_id) OVER same, FALSE) AS copied
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN copied THEN 'E' ELSE '' END AS fails
  FROM texts LEFT JOIN known USING (doc_id)
), counted AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL
), spread AS (
  SELECT *, contains(fails, letter) AS hit, regexp_matches(fails, '[' || earlier || '.]') AS gone
  FROM counted, steps
), audited AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost
  FROM spread GROUP BY ALL
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM audited
"""


def op13_cross_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two tokenizers align, and how usual their links are, by document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = cross_tokens.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                            public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.select("doc_id", *cross_tokens.MEASURES)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_mix_sources": op4_mix_sources,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_nearest": op9_nearest,
    "op10_simhash": op10_simhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_cross_tokens": op13_cross_tokens,
}
CHECKS = {
    "op1_chat_format": OP1_SQL,
    "op4_mix_sources": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
