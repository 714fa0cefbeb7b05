"""Explicit schemas (DDL) of the engine's tables; nothing is inferred but Parquet's own types."""

SOURCES = (
    "id BIGINT, type STRING, name STRING, url STRING, category STRING, status STRING, sort_order INT, "
    "fail_count INT, chat_id BIGINT, silent_alert_muted BOOLEAN, prompt_extra STRING, last_message_id BIGINT"
)
ITEMS = (
    "id BIGINT, source_id BIGINT, message_id STRING, original_url STRING, raw_text STRING, summary STRING, category STRING, "
    "published_at TIMESTAMP, processed_at TIMESTAMP, sent BOOLEAN, classify_attempts INT, duplicate_of BIGINT, "
    "blocked_reason STRING, views BIGINT, digest_day DATE, digest BIGINT"
)
VECTORS = "id BIGINT, v ARRAY<FLOAT>"
CATEGORIES = "name STRING, emoji STRING, sort_order INT, is_active BOOLEAN"
CATEGORY_TIMES = "category STRING, hour INT, minute INT"
RULES = "word_id BIGINT, rule STRING, label STRING"
RULE_CATEGORIES = "word_id BIGINT, category STRING"
RULE_SOURCES = "word_id BIGINT, source_id BIGINT"
DIGEST_LOG = "sent_at TIMESTAMP, items_total INT, status STRING"
FEED_ENTRIES = "source_id BIGINT, position INT, link STRING, title STRING, summary STRING, published STRING"
VERDICTS = "a BIGINT, b BIGINT, verdict STRING"
