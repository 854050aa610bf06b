"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwise.llm import (chat_format, collision_ann, collocations, edit_counts, feistel_pii, harmonic_packing, langid,
                         minmax_dedup, mixing, packing, pivot_topk, ring_sharding, token_alignment)
from revwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return add


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.expr(HELD_OUT).alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return (langid.predict(docs.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "lang_pred", "score"))


@query("op3_near_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
      WHERE 100 * p.i >= 75 * (na.n + nb.n - p.i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on whole 5-word shingle sets."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_feistel_pseudonyms")
def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses pseudonymized."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return feistel_pii.pseudonymize(docs)


@query("op4_source_mix")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, from the spans of its blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 4096."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_ring_shards")
def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"))
    return ring_sharding.assign_shards(rows, ["doc_id", "text_crc32"], "size", 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hops")


@query("op2_collision_search")
def op2_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every vec_id divisible by 50."""
    return collision_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op8_pivot_topk", """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20""")
def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of whole-number vectors for every vec_id divisible by 20."""
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op6_chat_tokens", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
m AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(?:/?s>|<SYS>>|</SYS>>)|\[\\*(?:/?INST\]|/?ROLE\]|OUT\])')) AS marks,
    len(regexp_extract_all(role, '<\\*(?:/?s>|<SYS>>|</SYS>>)|\[\\*(?:/?INST\]|/?ROLE\]|OUT\])')) AS role_marks
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(7 + sum(length(text) + marks + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
    ELSE 17 + length(role) + role_marks END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""")
def op6_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in marks, formatted to tokens and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], turns.schema)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat_format.read_chats(chat_format.format_chats(turns.union(more), ranks, pattern), ranks, pattern)


#: Edits of a text that follow from it: an insertion, a deletion and a replacement at places its checksum gives.
EDITS = """array(
  named_struct('at', pmod(crc32(text), length(text) + 1), 'removed', 0L, 'inserted', ' 42nd edit'),
  named_struct('at', pmod(crc32(reverse(text)), length(text) + 1), 'removed', 7L, 'inserted', ''),
  named_struct('at', pmod(xxhash64(text), length(text) + 1), 'removed', 3L, 'inserted', "It's"))"""


@query("op10_edit_counts")
def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(EDITS).alias("edits"))
    out = edit_counts.count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", *edit_counts.COLUMNS, F.crc32("text").alias("text_crc32"))


@query("op13_harmonic_packing")
def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    packed = harmonic_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level tokens aligned with its sentencepiece tokens, and corpus counts of their links."""
    out = token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k)),
t AS MATERIALIZED (SELECT lang, count(*) AS total FROM g WHERE words = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE words > 1),
q AS (
  SELECT c.lang, c.words, c.phrase, c.a, k, x.n AS l, y.n AS r, 2000000::HUGEINT * c.a // (x.n + y.n)::HUGEINT AS score
  FROM (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS tail
        FROM (SELECT *, unnest(range(1, words)) AS k FROM c)) c
  JOIN f x ON x.lang = c.lang AND x.phrase = c.head
  JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM q) WHERE o = 1),
d AS (
  SELECT DISTINCT e.lang, e.part AS phrase
  FROM (SELECT lang, a, words, m, array_to_string(w[i:i + m - 1], ' ') AS part
        FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM c, (VALUES (2), (3)) AS s(m) WHERE m < words)) e
  JOIN c ON c.lang = e.lang AND c.phrase = e.part AND c.words = e.m AND 100 * e.a >= 80 * c.a),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE d.phrase IS NULL)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, o.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
