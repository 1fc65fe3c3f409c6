"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat,
    decontaminate,
    html,
    mixing,
    neighbours,
    pii,
    quality,
    simhash,
    substrings,
    token_counts,
    urls,
    vector_codes,
    whitening,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's personal data, as spans."""
    docs = _table(spark, sf, "documents")
    rows = pii.find(docs, pii.fit(docs))

    def listed(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(counted, pii.BASE_KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's SimHash and the least doc_id of its group of near-duplicates."""
    rows = simhash.near_duplicates(_table(spark, sf, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's words hit by windows of benchmark items."""
    rows = decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    n_hit = decontaminate.n_hit()
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return token_counts.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's main text."""
    return html.extract(_table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return urls.verdicts(_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the passages that a document with a smaller id has too."""
    rows = substrings.without_repeats(_table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality, learned from the labels outside the held-out fold."""
    return quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every query vector."""
    return neighbours.nearest(_table(spark, sf, "embeddings"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.mixture(_table(spark, sf, "documents"))


def op11_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as training text, read back from it: its turns and what is under the loss mask."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    messages = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    rows = chat.format_conversations(messages).withColumns(
        {"_turns": chat.turns(F.col("formatted")), "_learned": chat.loss_text(F.col("formatted"), F.col("loss"))}
    )
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's whitened components."""
    return whitening.components(_table(spark, sf, "embeddings"))


def op13_vector_code_compression(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's code and error."""
    return vector_codes.codes(_table(spark, sf, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_mixing": op10_mixing,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_vector_code_compression": op13_vector_code_compression,
}

OP3 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM item_windows
), places AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), met AS (SELECT rid, k, i, item_id FROM places JOIN item_windows USING (k, gram)
), hit AS (
  SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS word FROM met) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

OP7 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
), first AS (SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram
), removed AS (
  SELECT DISTINCT rid, word FROM (
    SELECT rid, unnest(range(i, i + 50)) AS word FROM windows JOIN first USING (gram) WHERE doc_id > least)
), words AS (SELECT rid, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS word FROM docs
), kept AS (
  SELECT rid, count(*) AS n, string_agg(token, ' ' ORDER BY word) AS text
  FROM words ANTI JOIN removed USING (rid, word) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source
), sums AS (SELECT 3 * CAST(sum(source_size) AS HUGEINT) AS words3, sum(weight) AS weights FROM sources
), filled AS (  -- in the order in which sources become full
  SELECT *, row_number() OVER full_order AS k,
    coalesce(sum(source_size) OVER (full_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
    coalesce(sum(weight) OVER (full_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM sources, sums WINDOW full_order AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), last_open AS (
  SELECT min(k) AS k FROM filled
  WHERE weight * (words3 - 4 * size_before) <= 4 * CAST(source_size AS HUGEINT) * (weights - weight_before)
), level AS (
  SELECT words3 - 4 * size_before AS left2, weights - weight_before AS weight_left, k FROM filled JOIN last_open USING (k)
), targets AS (
  SELECT source, source_size,
    CASE WHEN f.k < l.k THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * left2 AS DOUBLE) / CAST(2 * weight_left AS DOUBLE) END AS target,
    CAST(CAST('0x' || substr(md5('42' || coalesce('=' || source, '-')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS start
  FROM filled f, level l
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.start,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS DOUBLE) AS place,
    t.target / nullif(CAST(t.source_size AS DOUBLE), 0) AS each
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * CAST(least(2, coalesce(floor((place + 1) * each + start) - floor(place * each + start), 0)) AS BIGINT) AS taken
FROM placed
"""

OP11 = r"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
  SELECT *,
    len(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(/?INST|/?SYS|/?ROLE|IMG|AUDIO|DOC|FILE)\]'))
      + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4
        ELSE 17 + len(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(/?INST|/?SYS|/?ROLE|IMG|AUDIO|DOC|FILE)\]')) END AS chars
  FROM messages
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM measured GROUP BY conv_id
"""

_PART = "CAST(len(x) AS BIGINT) // 8"
OP13_START = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    [CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), parts AS MATERIALIZED (
  SELECT rid, vec_id, label, part, x[part * ({_PART}) + 1 : (part + 1) * ({_PART})] AS v FROM kept, range(8) p(part)
), book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= 16
)"""
OP13_ROUND = """, near{0} AS MATERIALIZED (
  SELECT rid, part, v, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM (
    SELECT p.rid, p.part, p.v, b.entry, list_sum([(p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) FOR i IN range(1, len(p.v) + 1)])::BIGINT AS away
    FROM parts p JOIN book{0} b USING (part)) GROUP BY rid, part, v
), sum{0} AS (
  SELECT part, entry, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS c
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM near{0}) GROUP BY part, entry, i
), mean{0} AS (
  SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS v FROM sum{0} GROUP BY part, entry
), book{1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{0} b LEFT JOIN mean{0} m USING (part, entry)
)"""
OP13_END = """, final AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM near6 GROUP BY rid
), named AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book6
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN final USING (rid), named
"""
OP13 = OP13_START + "".join(OP13_ROUND.format(k, k + 1) for k in range(7)) + OP13_END

SQL: dict[str, str] = {
    "op13_vector_code_compression": OP13,"op11_chat_formatting": OP11, "op3_benchmark_decontamination": OP3, "op7_substring_dedup": OP7, "op10_mixing": OP10}
