"""Registered queries: a DataFrame plan over the views and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources import views as data
from newsloom.sources.views import Views

PLANS: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        PLANS[name] = f
        if sql is not None:
            oracle(name, sql)
        return f

    return register


def oracle(name: str, sql: str) -> None:
    """SQL of a plan: a query over the views of PRELUDE, or, from a comma on, further views and the query."""
    body = sql.strip()
    SQL[name] = f"WITH RECURSIVE {PRELUDE}{', ' + body[1:] if body.startswith(',') else ' ' + body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in PLANS.items()}


def values(rows: list[tuple]) -> str:
    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: The views of newsloom.sources.views in DuckDB's SQL.
PRELUDE = f"""
every_source AS (
  SELECT n AS id, CASE WHEN n % 2 = 0 THEN 'telegram' ELSE 'rss' END AS type, 'src' || n AS name,
         CASE WHEN n % 2 = 0 THEN '@src' || n ELSE 'https://src' || n || '.example.org/feed' END AS url,
         CASE n % 4 WHEN 0 THEN 'feed' WHEN 1 THEN 'finance' WHEN 2 THEN 'crypto' ELSE 'tech' END AS category,
         CASE WHEN n % 10 = 7 THEN 'paused' WHEN n % 10 = 9 THEN 'error' ELSE 'active' END AS status,
         CAST(n % 5 AS INT) AS sort_order, CAST(n % 7 AS INT) AS fail_count,
         CASE WHEN n % 2 = 0 THEN -1000000000000 - n END AS chat_id, n % 11 = 3 AS silent_alert_muted,
         CASE WHEN n % 6 = 0 THEN 'no merge' WHEN n % 6 = 4 THEN 'Please DO NOT TRANSLATE' WHEN n % 6 = 5 THEN 'don''t filter, thanks' END AS prompt_extra,
         n * 20 AS last_message_id
  FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS n FROM documents)),
sources AS (SELECT * FROM every_source WHERE id <> {data.VANISHED}),
items AS (
  SELECT id, source_id,
         CASE WHEN source_id % 2 = 0 THEN 'tg_src' || source_id || '_' || id ELSE md5('src' || source_id || ':' || id) END AS message_id,
         'https://example.org/src' || source_id || '/' || id AS original_url, raw_text,
         CASE WHEN id % 17 = 0 THEN '' ELSE substr(raw_text, 1, 120) END AS summary,
         CASE WHEN id % 29 = 0 THEN 'other' ELSE CASE source_id % 4 WHEN 0 THEN 'feed' WHEN 1 THEN 'finance' WHEN 2 THEN 'crypto' ELSE 'tech' END END AS category,
         CASE WHEN id % 31 <> 0 THEN TIMESTAMP '{data.EPOCH}' + to_minutes(CAST(id * 40 - id * 7 % 240 AS INT)) END AS published_at,
         TIMESTAMP '{data.EPOCH}' + to_minutes(CAST(id * 40 AS INT)) AS processed_at,
         id % 3 <> 0 AS sent, CAST(id % 5 AS INT) AS classify_attempts,
         nullif(min(id) OVER (PARTITION BY md5(raw_text)), id) AS duplicate_of,
         CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN ['ads', 'war', 'gone rule'][id % 3 + 1] END AS blocked_reason,
         CASE WHEN id % 13 <> 0 THEN id * 37 % 1000 END AS views,
         CAST(TIMESTAMP '{data.EPOCH}' + to_minutes(CAST(id * 40 AS INT)) AS DATE) AS digest_day, id // {data.ITEMS_A_DIGEST} AS digest
  FROM (SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, text AS raw_text FROM documents)),
vectors AS (SELECT vec_id AS id, embedding AS v FROM embeddings),
present AS (SELECT max(processed_at) AS as_of FROM items),
categories AS (
  SELECT category AS name, {data.EMOJI}[list_position({data.CATEGORY_NAMES}, category)] AS emoji, CAST(list_position({data.CATEGORY_NAMES}, category) - 1 AS INT) AS sort_order, true AS is_active FROM (SELECT DISTINCT category FROM every_source)
  UNION ALL SELECT 'in ' || lang, '🌐', 4, lang <> 'de' FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
keyed_events AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
category_times AS (SELECT DISTINCT {data.TIMED}[user_id % 8 + 1] AS category, CAST(user_id % 3 * 6 + 6 AS INT) AS hour, CASE WHEN k < 50 THEN 0 ELSE 30 END AS minute
  FROM keyed_events WHERE event_type = 'purchase' AND NOT (user_id % 8 = 2 AND k >= 50) AND (user_id % 8 < 4 OR user_id % 3 = 0)),
legacy_schedules AS (SELECT 'u' || user_id AS name, string_agg((k % 30) || ':' || (event_id % 70), ', ' ORDER BY event_id) AS digest_time FROM keyed_events GROUP BY user_id),
kept_rules AS (SELECT k AS word_id, 'rule ' || k AS rule, CASE WHEN k % 4 = 0 THEN 'Label ' || k END AS label FROM (SELECT DISTINCT k FROM keyed_events)),
kept_rule_categories AS (SELECT DISTINCT k AS word_id, {data.CATEGORY_NAMES}[user_id % 4 + 1] AS category FROM keyed_events WHERE event_type = 'purchase' AND k % 3 = 0),
kept_rule_sources AS (SELECT DISTINCT k AS word_id, user_id % 20 AS source_id FROM keyed_events WHERE event_type = 'click' AND k % 5 <> 0),
rules(word_id, rule, label) AS (VALUES {values(data.RULES)}),
rule_categories(word_id, category) AS (VALUES {values(data.RULE_CATEGORIES)}),
rule_sources(word_id, source_id) AS (VALUES {values(data.RULE_SOURCES)}),
digest_log AS (SELECT ts AS sent_at, CAST(k AS INT) AS items_total, CASE k % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'ok' END AS status FROM keyed_events WHERE event_type = 'purchase')"""
