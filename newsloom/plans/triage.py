"""Triage and housekeeping plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import analytics, assemble, queue, reposts, triage
from newsloom.plans.registry import plan
from newsloom.plans.texts import _LINES


@plan("image_reads", "SELECT id, length(regexp_replace(raw_text, '[^\\pL]', '', 'g')) < 80 AS few FROM items")
def _(v):
    return v.posts.select("id", triage.few_own_words(F.col("raw_text")).alias("few"))


@plan("shown_as_written", """SELECT i.id, length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) < 80 AND (length(regexp_replace(raw_text, '[^\\pL]', '', 'g')) < 4 OR (NOT regexp_matches(lower(raw_text), '[ñçéèê]') AND length(regexp_replace(raw_text, '[^a-zA-ZäöüßÄÖÜ]', '', 'g')) / greatest(length(regexp_replace(raw_text, '[^\\pL]', '', 'g')), 1) >= 0.4 AND regexp_matches(lower(raw_text), '[äöüß]'))
  OR coalesce(contains(lower(prompt_extra), 'no translat') OR contains(lower(prompt_extra), 'keep original language'), false)) AS written FROM items i LEFT JOIN sources s ON s.id = i.source_id""")
def _(v):
    raw = F.col("raw_text")
    reads = text.reads_as(text.without_media_prefix(raw), "a-zA-ZäöüßÄÖÜ", "äöüß", "ñçéèê")
    return queue.with_source(v.posts, v.sources).select("id", triage.shown_as_written(raw, F.col("source_prompt_extra"), reads).alias("written"))


@plan("unsigned_posts", f"""{_LINES}, signs AS (SELECT source_id, list(DISTINCT line) AS s FROM signed GROUP BY 1)
SELECT id FROM lined JOIN signs USING (source_id) WHERE len(l) > 0 AND len(list_filter(s, lambda x: ends_with(l[-1], x))) = 0""")
def _(v):
    signs = reposts.footer_round(v.posts.select("source_id", text.text_lines(F.col("raw_text")).alias("lines")), 3)
    return triage.unsigned(v.posts, signs).select("id")


@plan("young_sources", """, l AS (SELECT s.id, (SELECT max(processed_at) FROM items i WHERE i.source_id = s.id AND i.sent AND i.duplicate_of IS NOT NULL) AS last_item_at, as_of - to_hours(CAST(s.id * 10 AS INT)) AS created_at, as_of FROM sources s, present)
SELECT id, last_item_at IS NULL AND created_at > as_of - INTERVAL 120 HOUR AS too_young FROM l""")
def _(v):
    last = v.items.filter("sent AND duplicate_of IS NOT NULL").groupBy(F.col("source_id").alias("id")).agg(F.max("processed_at").alias("last_item_at"))
    rows = v.sources.join(last, "id", "left").withColumn("created_at", v.as_of - F.make_dt_interval(F.lit(0), (F.col("id") * 10).cast("int")))
    return triage.too_young(rows, v.as_of, 120).select("id", "too_young")


@plan("throttle_streaks", """, e AS (SELECT event_type || ':' || user_id % 10 AS tag, ts, event_id, value > 20 AS bad FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts, event_id) AS k FROM e),
w(tag, k, c, f, l, dead) AS (SELECT tag, k, CASE WHEN bad THEN 1 ELSE 0 END, ts, ts, CAST(NULL AS TIMESTAMP) FROM n WHERE k = 1
  UNION ALL SELECT n.tag, n.k, CASE WHEN NOT n.bad THEN 0 WHEN w.c = 0 OR epoch(n.ts - w.l) > 36000 OR epoch(n.ts - w.f) > 72000 THEN 1 ELSE w.c + 1 END,
    CASE WHEN n.bad AND (w.c = 0 OR epoch(n.ts - w.l) > 36000 OR epoch(n.ts - w.f) > 72000) THEN n.ts ELSE w.f END, CASE WHEN n.bad THEN n.ts ELSE w.l END,
    CASE WHEN w.dead IS NULL AND n.bad AND NOT (w.c = 0 OR epoch(n.ts - w.l) > 36000 OR epoch(n.ts - w.f) > 72000) AND w.c + 1 >= 3 AND epoch(n.ts - w.f) >= 900 THEN n.ts ELSE w.dead END
  FROM w JOIN n ON n.tag = w.tag AND n.k = w.k + 1)
SELECT tag, CAST(floor(epoch(max(dead))) AS BIGINT) AS dead_at, CAST(arg_max(c, k) AS BIGINT) AS count FROM w GROUP BY 1""")
def _(v):
    e = v.table("events")
    answers = e.select(F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("tag"), F.col("ts").cast("timestamp").alias("moment"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("throttled"))
    return triage.throttle_streaks(answers, 3, 900, 36000, 72000).select("tag", F.unix_timestamp("dead_at").alias("dead_at"), "count")


@plan("filtered_sections", """SELECT i.digest, CASE WHEN ltrim(blocked_reason) LIKE '=%' THEN '= exact phrases' ELSE blocked_reason END AS section, max(CASE WHEN ltrim(blocked_reason) NOT LIKE '=%' THEN nullif(trim(coalesce(label, '')), '') END) AS title, count(*) AS n
FROM items i LEFT JOIN rules r ON r.rule = i.blocked_reason WHERE blocked_reason IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return triage.filtered_sections(v.judged.filter("blocked_reason IS NOT NULL").select("digest", "id", F.col("blocked_reason").alias("rule")), v.rules)


@plan("source_pages", "SELECT category, id, (row_number() OVER (PARTITION BY category ORDER BY sort_order, name) - 1) // 2 AS page FROM sources")
def _(v):
    return triage.paged(v.sources, [F.col("sort_order"), F.col("name")], 2, "category").select("category", "id", "page")


@plan("fires_at", "SELECT name, name IN (SELECT category FROM category_times WHERE hour = 18 AND minute = 30) AND name IN (SELECT category FROM category_times WHERE hour = 6 AND minute = 0) AS fires FROM categories WHERE is_active")
def _(v):
    return triage.fires_at(analytics.category_times_text(v.categories, v.category_times), F.lit("18:30,6:00")).select("name", "fires")


@plan("rule_choices", "SELECT id, chosen, row_number() OVER (PARTITION BY category ORDER BY lower(name), id) AS place FROM (SELECT *, id IN (SELECT source_id FROM rule_sources WHERE word_id = 4) AS chosen FROM sources) WHERE chosen OR status = 'active'")
def _(v):
    return triage.rule_choices(v.sources, v.rule_sources, 4).select("id", "chosen", "place")


@plan("latest_settings", "SELECT user_id || ':' || event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(v):
    return triage.latest_settings(v.table("events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "value", F.col("event_id").alias("seq")))


@plan("attempts", """, f AS (SELECT event_id % (SELECT count(*) FROM items) AS id, count(*) AS failed FROM events WHERE event_type = 'error' GROUP BY 1), a AS (SELECT i.id, CAST(classify_attempts + coalesce(failed, 0) AS INT) AS classify_attempts, summary, raw_text FROM items i LEFT JOIN f USING (id))
SELECT id, classify_attempts, md5(CASE WHEN classify_attempts >= 5 AND trim(summary) = '' THEN '⚠️ ' || substr(split_part(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g'), chr(10), 1), 1, 80) ELSE summary END) AS summary_md5 FROM a""")
def _(v):
    n = v.table("documents").count()
    failures = v.table("events").filter("event_type = 'error'").select((F.col("event_id") % F.lit(n)).alias("id"))
    return triage.with_attempts(v.posts, failures, 5).select("id", "classify_attempts", F.md5("summary").alias("summary_md5"))


@plan("schedule_writes", "SELECT category, hour, minute FROM category_times WHERE NOT (hour = 6 AND minute = 0) UNION SELECT 'feed', 6, 15 UNION SELECT 'feed', 18, 30")
def _(v):
    """A time removed everywhere, two added, one of which is there."""
    added = v.literal([("feed", 6, 15), ("feed", 18, 30)], "category string, hour int, minute int")
    return v.category_times.filter("NOT (hour = 6 AND minute = 0)").unionByName(added).distinct()


@plan("slow_digests", "SELECT digest, count(*) AS n, greatest(180.0::DOUBLE, 1.5::DOUBLE * count(*)) AS slow_after FROM items WHERE NOT sent GROUP BY 1")
def _(v):
    return v.posts.filter("NOT sent").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).withColumn("slow_after", F.greatest(F.lit(180.0), F.lit(1.5) * F.col("n")))


@plan("measured_ages", "SELECT id, round(epoch(processed_at - published_at) / 3600, 1) AS hours FROM items WHERE published_at IS NOT NULL")
def _(v):
    return v.posts.filter("published_at IS NOT NULL").select("id", F.round((F.unix_timestamp("processed_at") - F.unix_timestamp("published_at")) / 3600, 1).alias("hours"))


@plan("pictures_read", """, p AS (SELECT CAST(ts AS DATE) AS cycle, event_id AS seq, CASE WHEN k % 7 <> 0 THEN k * 60000 END AS size, k / 4.0::DOUBLE AS seconds FROM keyed_events WHERE event_type = 'view'),
f AS (SELECT *, coalesce(size <= 5242880, true) AS fits FROM p)
SELECT seq AS id, fits AND coalesce(count(*) FILTER (fits) OVER w, 0) < 12 AND coalesce(sum(seconds) FILTER (fits) OVER w, 0) <= 90 AS read FROM f WINDOW w AS (PARTITION BY cycle ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(v):
    """Views of a day as the pictures of a cycle."""
    k = F.col("k")
    pictures = v.keyed_events.filter("event_type = 'view'").select(F.col("ts").cast("date").alias("cycle"), F.col("event_id").alias("seq"), F.when(k % 7 != 0, k * 60000).alias("size"), (k / 4.0).alias("seconds"))
    return triage.pictures_read(pictures).select(F.col("seq").alias("id"), "read")


@plan("own_adverts", f"""{_LINES}, signs AS (SELECT source_id, list(DISTINCT line) AS s FROM signed GROUP BY 1)
SELECT i.id FROM items i JOIN lined USING (id) JOIN signs g ON g.source_id = i.source_id WHERE len(l) > 0 AND len(list_filter(s, lambda x: ends_with(l[-1], x))) = 0
  AND i.source_id % 3 <> 0 AND trim(i.summary) <> '' AND i.id % 2 = 0 AND (i.id % 5 = 0 OR i.id % 11 >= 8)""")
def _(v):
    """Unsigned posts of sources that want no filter; a provider that answers about every second post."""
    n = F.col("id")
    signs = reposts.footer_round(v.posts.select("source_id", text.text_lines(F.col("raw_text")).alias("lines")), 3)
    posts = v.posts.withColumn("prompt", F.when(F.col("source_id") % 3 != 0, "Please: NO FILTER"))
    answers = v.posts.filter(n % 2 == 0).select("id", F.when(n % 5 != 0, n % 11).alias("confidence"))
    return triage.own_adverts(posts, signs, answers)


@plan("silent_block", """, q AS (SELECT s.id, name, type, url, max(i.processed_at) AS last, as_of FROM sources s LEFT JOIN items i ON i.source_id = s.id, present WHERE status = 'active' AND NOT silent_alert_muted GROUP BY ALL HAVING last IS NULL OR last < as_of - INTERVAL 8 HOUR),
l AS (SELECT *, CASE WHEN type = 'telegram' THEN 'https://t.me/' || substr(url, 2) ELSE url END AS link FROM q)
SELECT coalesce('<blockquote expandable><b>💤 Quiet sources</b> (5+ days without new items)' || chr(10) || string_agg('• <a href="' || link || '">' || name || '</a> — ' || CASE WHEN last IS NULL THEN 'never' ELSE CAST(CAST(floor(epoch(as_of - last) / 3600) AS BIGINT) // 24 AS VARCHAR) || 'd' END, chr(10) ORDER BY last NULLS FIRST, id) || '</blockquote>', '') AS text FROM l""")
def _(v):
    return assemble.silent_block(analytics.silent(v.posts, v.sources, v.as_of, 8))
