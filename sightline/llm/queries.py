"""The queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, lexical_search, line_dedup, lm_scoring, packing, secret_scan, sentence_pieces, simhash, substring_dedup, token_counts, topk_search, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and which of them repeat an earlier line up to one edit."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors; 5 best each."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of ids and text."""
    out = sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with an earlier one."""
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, verbatim or with other values."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learned from those outside fold 2 of 7."""
    return lm_scoring.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added secret spans of every document."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels, fold("doc_id", 3) != 1))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans.alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and hash of the repaired text of every conversation, after damage by a hash."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) % 20 AS code
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS c,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id
), inserts(a, b, cost, audit, added) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
    (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, i, s.a, s.a AS b, 4 AS cost, 'D' AS audit, [] AS added FROM faulty, (VALUES (0), (1), (2), (3)) s(a)
  UNION ALL
  SELECT conv_id, i, k.a, k.b, CASE WHEN fault = '' THEN 0 ELSE 3 END, 'K', [role || ':' || text] FROM faulty JOIN (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) k(c, a, b) USING (c) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, k.a, k.b, CASE WHEN fault = '' THEN 3 ELSE 6 END, 'R', [k.name || ':' || text] FROM faulty, (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) k(a, b, name) WHERE fault IN ('', 'truncated')
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, b AS state, inserts.cost::BIGINT AS cost, audit, added::VARCHAR[] AS lines FROM counts, inserts WHERE a = 0
  UNION ALL
  SELECT conv_id, i, state, best['cost'], best['audit'], best['lines'] FROM (
    SELECT w.conv_id, e.i, n.b AS state, min(struct_pack("cost" := w.cost + e.cost + n.cost, "audit" := w.audit || e.audit || n.audit, "lines" := w.lines || e.added::VARCHAR[] || n.added::VARCHAR[])) AS best
    FROM walk w JOIN edits e ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = w.i + 1 AND e.a = w.state JOIN inserts n ON n.a = e.b GROUP BY w.conv_id, e.i, n.b)
), ended AS (
  SELECT w.conv_id, min(struct_pack("cost" := w.cost, "audit" := w.audit, "lines" := w.lines)) AS best FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE w.state IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best['cost'], 0) AS cost, coalesce(best['audit'], '') AS audit, sha256(coalesce(array_to_string(best['lines'], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, t, len(t)::BIGINT AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE text IS NOT NULL) WHERE len(t) > 0
), totals AS (
  SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY term, nn
), q AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)
), s AS (
  SELECT i, item_id, doc_id, d.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.r = tf.r, totals GROUP BY i, item_id, doc_id, d.r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), room=4096, closing=2)


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_top_k_search": op2_top_k_search,
        "op3_sentence_pieces": op3_sentence_pieces,
        "op4_simhash": op4_simhash,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_token_counts": op7_token_counts,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_secret_scan": op9_secret_scan,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_ranked_lexical_search": op12_ranked_lexical_search,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k_search": OP2_SQL, "op11_conversation_repair": OP11_SQL, "op12_ranked_lexical_search": OP12_SQL}
