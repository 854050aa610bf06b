"""Named queries over the test tables and their DuckDB twins.

``@query(name, sql)`` registers a callable ``(spark, sf_dir) -> DataFrame``
and, when given, the SQL that DuckDB runs on the same parquet tables.  The
SQL snippets below rebuild the adapter views of ``revwise.sources.testdata``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revwise.plans import sqlparts as S

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` may be a function where it needs the session (stop words)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle() -> dict[str, str]:
    """The DuckDB twins as text."""
    return {k: (v if isinstance(v, str) else v()).strip() for k, v in ORACLE.items()}


# --- SQL twins of the adapter views (DuckDB dialect) -----------------------

REVIEWS_CTE = """
reviews AS (
  SELECT sha1((CASE WHEN d.doc_id % 4 = 0 THEN 'appstore' ELSE 'playstore' END)
              || CAST(d.doc_id AS VARCHAR)) AS id,
         d.source AS product_key,
         CASE WHEN d.doc_id % 4 = 0 THEN 'appstore' ELSE 'playstore' END AS source,
         CAST(d.doc_id AS VARCHAR) AS external_id,
         d.text AS body,
         CAST(CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 0 THEN 2
                   WHEN l.quality = 1 THEN 3 + d.doc_id % 3 END AS INTEGER) AS rating,
         CAST(NULL AS VARCHAR) AS title,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS BIGINT)) AS posted_at,
         CAST(NULL AS VARCHAR) AS version,
         d.lang AS language,
         'in' AS country,
         TIMESTAMP '2024-06-01 00:00:00' AS ingested_at,
         d.doc_id AS doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

RUN_EVENTS_CTE = """
run_events AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'ingested'
              WHEN 'click' THEN 'clustered' WHEN 'purchase' THEN 'summarized'
              WHEN 'error' THEN 'failed' END AS status,
         ts AS updated_at, event_id AS seq, value, event_type
  FROM events
)"""

CLUSTER_VECTORS_CTE = """
cluster_vectors AS (
  SELECT 'run-0' AS run_id, CAST(vec_id AS VARCHAR) AS review_id, vec_id, embedding,
         label - 1 AS cluster
  FROM embeddings
)"""

CALL_LOG_CTE = """
call_log AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS INTEGER) AS seq, role,
         length(text) % 5 <> 0 AS ok,
         CAST(CASE WHEN role IN ('user', 'system') THEN length(text) // 4 ELSE 0 END AS BIGINT)
           AS prompt_tokens,
         CAST(CASE WHEN role IN ('user', 'system') THEN 0 ELSE length(text) // 4 END AS BIGINT)
           AS completion_tokens
  FROM conversations
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

CLUSTERED_REVIEWS_CTE = f"""
sreviews AS (
  SELECT * REPLACE ({S.mask_sql('body')} AS body) FROM reviews WHERE {S.valid_sql()}),
creviews AS (
  SELECT 'run-0' AS run_id, r.id AS review_id, r.doc_id, e.embedding, e.label - 1 AS cluster,
         r.body, r.rating, r.source, r.posted_at, r.product_key
  FROM embeddings e JOIN sreviews r ON r.doc_id = e.vec_id
)"""
