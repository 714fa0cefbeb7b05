"""Queue, state and analytics plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import clock
from newsloom.operators import analytics, queue, sketches, state
from newsloom.operators.graph import shared_folder
from newsloom.plans.registry import plan
from newsloom.sources import views as data

_QUEUE = """, queue AS (
  SELECT i.*, s.name AS source_name, s.type AS source_type, s.sort_order AS source_sort_order, s.prompt_extra AS source_prompt_extra
  FROM items i LEFT JOIN sources s ON s.id = i.source_id WHERE NOT i.sent AND coalesce(s.status, '') <> 'paused')"""


@plan("queue_unsent", f"""{_QUEUE}
SELECT id, category, source_name, source_type, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published,
       row_number() OVER (PARTITION BY digest_day ORDER BY category, source_sort_order NULLS FIRST, source_id, published_at NULLS FIRST, id) AS position FROM queue""")
def _(v):
    return queue.positions(queue.unsent(v.posts, v.sources)).select("id", "category", "source_name", "source_type", clock.stamp(F.col("published_at")).alias("published"), "position")


@plan("queue_of_categories", f"""{_QUEUE} SELECT id, source_name FROM queue WHERE category IN ('crypto', 'other')""")
def _(v):
    return queue.unsent(v.posts, v.sources, ["crypto", "other"]).select("id", "source_name")


@plan("queue_count", f"""{_QUEUE} SELECT count(*) AS n FROM queue""")
def _(v):
    return queue.unsent(v.posts, v.sources).agg(F.count(F.lit(1)).alias("n"))


@plan("needs_summary", "SELECT id FROM items WHERE trim(summary) = '' AND trim(raw_text) <> ''")
def _(v):
    return queue.needs_summary(v.posts).select("id")


@plan("sent_but_empty", "SELECT i.id, s.prompt_extra AS source_prompt_extra FROM items i LEFT JOIN sources s ON s.id = i.source_id WHERE sent AND trim(summary) = '' AND trim(raw_text) <> '' ORDER BY i.id DESC LIMIT 5")
def _(v):
    return queue.sent_but_empty(v.posts, v.sources).select("id", "source_prompt_extra")


@plan("recent_texts", "SELECT id, source_id, md5(raw_text) AS text_md5, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS rank FROM items) WHERE rank <= 7")
def _(v):
    return queue.newest_of_each_source(v.posts, 7).select("id", "source_id", F.md5("raw_text").alias("text_md5"), "rank")


@plan("vector_pool", "SELECT i.id, i.sent, s.sort_order AS source_sort_order, len(v.v) AS dims FROM items i JOIN vectors v USING (id) LEFT JOIN sources s ON s.id = i.source_id, present WHERE blocked_reason IS NULL AND processed_at >= as_of - INTERVAL 600 HOUR")
def _(v):
    return queue.vector_pool(v.judged, v.vectors, v.sources, v.as_of, 600).select("id", "sent", "source_sort_order", F.size("v").alias("dims"))


@plan("sent_text_pool", "SELECT id, source_id, duplicate_of, length(raw_text) AS chars FROM items, present WHERE sent AND blocked_reason IS NULL AND processed_at >= as_of - INTERVAL 48 HOUR")
def _(v):
    return queue.text_pool(v.items, v.as_of, 48).select("id", "source_id", "duplicate_of", F.length("raw_text").alias("chars"))


@plan("items_by_message_id", "SELECT id, message_id, source_id, duplicate_of FROM items WHERE message_id IN ('tg_src0_0', 'tg_src2_22', 'none', md5('src1:1'), md5('src7:47'))")
def _(v):
    wanted = [F.lit("tg_src0_0"), F.lit("tg_src2_22"), F.lit("none"), F.md5(F.lit("src1:1").cast("binary")), F.md5(F.lit("src7:47").cast("binary"))]
    return v.items.filter(F.col("message_id").isin(*wanted)).select("id", "message_id", "source_id", "duplicate_of")


@plan("source_lists", "SELECT status, type, category, id, name, row_number() OVER (PARTITION BY status, type ORDER BY sort_order, name) AS place FROM sources")
def _(v):
    from pyspark.sql import Window

    return v.sources.select("status", "type", "category", "id", "name", F.row_number().over(Window.partitionBy("status", "type").orderBy("sort_order", "name")).alias("place"))


@plan("rule_scopes", """SELECT word_id, rule, coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM kept_rule_categories c WHERE c.word_id = r.word_id), '') AS categories,
  coalesce((SELECT string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) FROM kept_rule_sources s WHERE s.word_id = r.word_id), '') AS sources FROM kept_rules r""")
def _(v):
    c = v.kept_rule_categories.groupBy("word_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    s = v.kept_rule_sources.groupBy("word_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("source_id")), lambda x: x.cast("string")), ",").alias("sources"))
    out = v.kept_rules.join(c, "word_id", "left").join(s, "word_id", "left")
    return out.select("word_id", "rule", F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("sources", F.lit("")).alias("sources"))


@plan("stats_totals", "SELECT count(*) FILTER (processed_at >= as_of - INTERVAL 24 HOUR) AS total, count(*) FILTER (NOT sent) AS pending FROM items, present")
def _(v):
    return analytics.totals(v.posts, v.as_of)


_BY_SOURCE = """, per_source AS (
  SELECT s.id AS source_id, s.name, s.category, coalesce(c.sort_order, 999) AS category_order,
         count(*) FILTER (processed_at >= as_of - INTERVAL 24 HOUR) AS cnt, count(*) FILTER (NOT sent) AS unsent_cnt,
         count(*) FILTER (duplicate_of IS NOT NULL AND processed_at >= as_of - INTERVAL 24 HOUR) AS muted_cnt
  FROM items i JOIN sources s ON s.id = i.source_id LEFT JOIN categories c ON c.name = s.category, present
  GROUP BY ALL HAVING cnt > 0 OR unsent_cnt > 0)"""


@plan("stats_by_source", f"{_BY_SOURCE} SELECT * FROM per_source")
def _(v):
    return analytics.by_source(v.items, v.sources, v.categories, v.as_of)


@plan("stats_by_category", f"""{_BY_SOURCE}
SELECT p.category, coalesce(max(c.emoji), '📌') AS emoji, CAST(sum(cnt) AS BIGINT) AS total, CAST(sum(muted_cnt) AS BIGINT) AS muted,
       string_agg(p.name || ':' || cnt || ':' || unsent_cnt, ' ' ORDER BY cnt DESC, p.name) AS sources
FROM per_source p LEFT JOIN categories c ON c.name = p.category AND c.is_active GROUP BY p.category""")
def _(v):
    return analytics.by_category(analytics.by_source(v.items, v.sources, v.categories, v.as_of), v.categories)


_SILENT = """, last AS (SELECT source_id, max(processed_at) AS last_item_at FROM items GROUP BY 1), silent AS (
  SELECT s.id, s.name, s.category, last_item_at, CAST(floor(epoch(as_of - last_item_at) / 3600) AS BIGINT) AS hours_silent
  FROM sources s LEFT JOIN last l ON l.source_id = s.id, present
  WHERE status = 'active' AND NOT silent_alert_muted AND (last_item_at IS NULL OR last_item_at < as_of - INTERVAL 8 HOUR))"""


@plan("silent_sources", f"{_SILENT} SELECT id, name, strftime(last_item_at, '%Y-%m-%d %H:%M:%S') AS last_item, hours_silent FROM silent")
def _(v):
    return analytics.silent(v.posts, v.sources, v.as_of, 8).select("id", "name", clock.stamp(F.col("last_item_at")).alias("last_item"), "hours_silent")


@plan("silent_fresh", f"{_SILENT} SELECT id FROM silent WHERE id NOT IN (2, 4, 6)")
def _(v):
    """Silent sources that weren't reported yet."""
    already = v.spark.range(2, 8, 2)
    return analytics.silent(v.posts, v.sources, v.as_of, 8).select("id").join(already, "id", "left_anti")


@plan("source_health", """SELECT source_id, round(epoch(max(as_of) - max(processed_at)) / 3600, 6) AS hours_since, count(*) FILTER (processed_at >= as_of - INTERVAL 7 DAY) AS week_total,
  count(*) FILTER (processed_at >= as_of - INTERVAL 7 DAY AND duplicate_of IS NOT NULL) AS week_muted FROM items, present GROUP BY 1""")
def _(v):
    return analytics.health(v.items, v.as_of)


@plan("rule_hits", "SELECT rule, label, (SELECT count(*) FROM items, present WHERE blocked_reason = rule AND processed_at >= as_of - INTERVAL 20 DAY) AS n FROM rules")
def _(v):
    return analytics.rule_hits(v.judged, v.rules, v.as_of, 20)


@plan("engagement_vs_median", f"""{_QUEUE}, base AS (
  SELECT source_id, median(views) AS usual, count(*) AS posts FROM items, present WHERE views IS NOT NULL AND sent AND duplicate_of IS NULL AND blocked_reason IS NULL AND published_at > as_of - INTERVAL 20 DAY
  GROUP BY 1 HAVING posts >= 10 AND usual > 0)
SELECT id, source_id, views, CAST(usual AS DOUBLE) AS usual, round(views / usual, 6) AS ratio FROM queue JOIN base USING (source_id) WHERE views IS NOT NULL ORDER BY ratio DESC, id LIMIT 5""")
def _(v):
    base = analytics.views_baseline(v.items, v.as_of, days=20)
    return analytics.engagement(queue.unsent(v.items, v.sources), base).select("id", "source_id", "views", "usual", "ratio")


@plan("views_sketched", """, c AS (SELECT source_id, views, CAST(published_at AS DATE) AS day FROM items WHERE views IS NOT NULL AND sent AND duplicate_of IS NULL AND blocked_reason IS NULL AND published_at IS NOT NULL),
r AS (SELECT source_id, list(views ORDER BY views) AS l FROM c, present WHERE day > CAST(as_of AS DATE) - 20 AND day <= CAST(as_of AS DATE) GROUP BY 1)
SELECT source_id, l[CAST(ceil(len(l) / 2) AS INT)] AS usual, len(l) AS posts FROM r WHERE len(l) >= 10 AND l[CAST(ceil(len(l) / 2) AS INT)] > 0""")
def _(v):
    """The lower median of twenty days from a sketch of each source and day; exact up to 400 posts of a source, as here."""
    path = shared_folder(v.spark) + "/newsloom-sketches-" + uuid.uuid4().hex
    sketches.add_days(v.items, path)
    last = v.spark.range(1).select(v.as_of.cast("date").alias("d")).first().d
    return sketches.baseline(v.spark, path, last, 20)


@plan("digest_health", """SELECT count(*) AS digests, CAST(coalesce(sum(items_total), 0) AS BIGINT) AS items, count(*) FILTER (status <> 'ok') AS not_ok,
  coalesce(string_agg(DISTINCT status, ',' ORDER BY status) FILTER (status <> 'ok'), '') AS statuses, count(*) = 0 OR count(*) FILTER (status <> 'ok') > 0 AS alert
FROM digest_log WHERE sent_at >= TIMESTAMP '2024-01-03 12:00:00' - INTERVAL 36 HOUR""")
def _(v):
    return analytics.digest_health(v.digest_log, F.lit("2024-01-03 12:00:00").cast("timestamp"), 36)


@plan("last_digest", "SELECT strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS at, items_total, status FROM digest_log ORDER BY sent_at DESC LIMIT 1")
def _(v):
    return v.digest_log.orderBy(F.col("sent_at").desc()).limit(1).select(clock.stamp(F.col("sent_at")).alias("at"), "items_total", "status")


_TIMES = """, timed AS (SELECT name, emoji, sort_order, coalesce((SELECT string_agg(printf('%02d:%02d', hour, minute), ',' ORDER BY hour, minute) FROM category_times WHERE category = name), '') AS digest_time FROM categories WHERE is_active)"""


@plan("category_times_label", f"{_TIMES} SELECT name, digest_time FROM timed")
def _(v):
    return analytics.category_times_text(v.categories, v.category_times).select("name", "digest_time")


@plan("schedule_slots", "SELECT printf('%02d:%02d', hour, minute) AS at, string_agg(category, ',' ORDER BY sort_order, category) AS categories FROM category_times t JOIN categories c ON c.name = t.category WHERE is_active GROUP BY 1")
def _(v):
    return analytics.schedule_slots(v.categories, v.category_times)


@plan("timetable_groups", f"{_TIMES}, g AS (SELECT digest_time, count(*) AS size, string_agg(name, ',' ORDER BY sort_order, name) AS categories FROM timed GROUP BY 1) SELECT *, row_number() OVER (ORDER BY digest_time = '', size DESC, digest_time) AS place FROM g")
def _(v):
    return analytics.timetable_groups(analytics.category_times_text(v.categories, v.category_times))


@plan("schedule_split", """SELECT DISTINCT name, CAST(h * 60 + m AS INT) AS minute FROM (
  SELECT name, try_cast(split_part(trim(x), ':', 1) AS INT) AS h, try_cast(split_part(trim(x), ':', 2) AS INT) AS m
  FROM (SELECT name, unnest(string_split(digest_time, ',')) AS x FROM legacy_schedules))
WHERE h BETWEEN 0 AND 23 AND m BETWEEN 0 AND 59""")
def _(v):
    return state.split_schedule(v.legacy_schedules)


@plan("next_slot", """, slots AS (SELECT DISTINCT hour * 60 + minute AS s FROM category_times JOIN categories ON name = category WHERE is_active), w AS (
  SELECT m AS minute, CAST(min(CASE WHEN s > m THEN s ELSE s + 1440 END) - m AS INT) AS wait FROM (SELECT unnest(range(0, 1440, 65)) AS m), slots GROUP BY m)
SELECT minute, wait, printf('%02d:%02d', (minute + wait) % 1440 // 60, (minute + wait) % 60) AS at, printf('%dh %02dm', wait // 60, wait % 60) AS countdown FROM w""")
def _(v):
    active = v.category_times.join(v.categories.filter("is_active").select(F.col("name").alias("category")), "category", "left_semi")
    moments = v.spark.range(0, 1440, 65).withColumnRenamed("id", "minute")
    out = analytics.next_slot(moments, active)
    return out.select("minute", F.col("wait").cast("int").alias("wait"), "at", clock.countdown(F.col("wait")).alias("countdown"))


@plan("source_counts", f"{_SILENT} SELECT category, count(*) AS sources, count(*) FILTER (status = 'paused') AS paused, (SELECT count(*) FROM silent q WHERE q.category = s.category) AS quiet FROM sources s GROUP BY category")
def _(v):
    return analytics.source_counts(v.sources, analytics.silent(v.posts, v.sources, v.as_of, 8))


@plan("home_state", f"""{_QUEUE}{_SILENT}
SELECT (SELECT count(*) FROM queue) AS pending, (SELECT count(*) FROM silent) AS quiet, (SELECT count(*) FROM sources WHERE status = 'active') AS active, (SELECT count(*) FROM sources WHERE status = 'pending') AS joining,
       (SELECT count(*) FROM sources WHERE status = 'error') AS error, (SELECT count(*) FROM sources WHERE status = 'paused') AS paused, (SELECT arg_max(status, sent_at) FROM digest_log) AS last_status,
       (SELECT strftime(max(sent_at), '%Y-%m-%d %H:%M:%S') FROM digest_log) AS last_digest""")
def _(v):
    return analytics.home_state(v.sources, queue.unsent(v.posts, v.sources), analytics.silent(v.posts, v.sources, v.as_of, 8), v.digest_log)


@plan("failure_streaks", """, polls AS (SELECT user_id AS source_id, ts AS moment, event_type = 'error' AS failed, event_id AS seq FROM events),
flagged AS (SELECT *, CASE WHEN failed AND coalesce(lag(failed) OVER w, false) AND epoch(moment - lag(moment) OVER w) / 60 <= 1000 THEN 0 ELSE 1 END AS new FROM polls WINDOW w AS (PARTITION BY source_id ORDER BY moment, seq)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY moment, seq ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
SELECT source_id, CAST(run AS BIGINT) AS run, count(*) AS failures FROM runs WHERE failed GROUP BY ALL HAVING count(*) >= 2""")
def _(v):
    polls = v.table("events").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("seq"))
    return analytics.failure_streaks(polls, 1000).filter("failures >= 2").select("source_id", "run", "failures")


@plan("message_ids", "SELECT id, message_id FROM items")
def _(v):
    return v.posts.select("id", "message_id")


_INCOMING = """, incoming AS (SELECT id AS no, CASE WHEN id % 4 = 0 THEN message_id ELSE message_id || '_new' END AS message_id FROM items)"""


def _incoming(v):
    m = F.col("message_id")
    return v.posts.select(F.col("id").alias("no"), F.when(F.col("id") % 4 == 0, m).otherwise(F.concat(m, F.lit("_new"))).alias("message_id"))


@plan("seen_semi", f"{_INCOMING} SELECT no FROM incoming WHERE message_id IN (SELECT message_id FROM items)")
def _(v):
    return state.seen(_incoming(v), v.posts).select("no")


@plan("unseen_anti", f"{_INCOMING} SELECT no FROM incoming WHERE message_id NOT IN (SELECT message_id FROM items)")
def _(v):
    return state.unseen(_incoming(v), v.posts).select("no")


@plan("insert_or_ignore", """SELECT c.message_id, turn FROM (SELECT 'tg_src0_' || conv_id AS message_id, min(turn) AS turn FROM conversations GROUP BY 1) c WHERE c.message_id NOT IN (SELECT message_id FROM items)""")
def _(v):
    incoming = v.table("conversations").select(F.concat(F.lit("tg_src0_"), F.col("conv_id")).alias("message_id"), "turn")
    return state.insert_or_ignore(v.posts, incoming, "message_id", [F.col("turn")]).select("message_id", "turn")


@plan("mark_duplicates", "SELECT id, sent OR duplicate_of IS NOT NULL AS sent, duplicate_of FROM items")
def _(v):
    facts = v.items.filter("duplicate_of IS NOT NULL").select("id", F.col("duplicate_of").alias("primary_id"))
    before = v.items.withColumn("duplicate_of", F.lit(None).cast("bigint"))
    return state.mark_duplicates(before, facts).select("id", "sent", "duplicate_of")


@plan("mark_blocked", "SELECT id, sent OR blocked_reason IS NOT NULL AS sent, blocked_reason FROM items")
def _(v):
    facts = v.judged.filter("blocked_reason IS NOT NULL").select("id", F.col("blocked_reason").alias("reason"))
    return state.mark_blocked(v.posts.withColumn("blocked_reason", F.lit(None).cast("string")), facts).select("id", "sent", "blocked_reason")


@plan("discard_queue", "SELECT id, md5(CASE WHEN trim(coalesce(summary, '')) = '' THEN substr(raw_text, 1, 200) ELSE summary END) AS summary_md5 FROM items WHERE NOT sent AND source_id IN (SELECT id FROM sources WHERE status = 'paused')")
def _(v):
    paused = v.sources.filter("status = 'paused'").select(F.col("id").alias("source_id"))
    return state.discard_queue(v.posts, paused).filter("discarded").select("id", F.md5("summary").alias("summary_md5"))


@plan("retention_prune", "SELECT source_id, count(*) AS n FROM items, present WHERE NOT (sent AND processed_at < as_of - INTERVAL 10 DAY) GROUP BY 1")
def _(v):
    return state.prune(v.posts, v.as_of, 10).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@plan("engagement_refresh", """, c AS (SELECT event_id % (SELECT count(*) FROM items) AS id, arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)) AS views, max(ts) AS seen FROM events GROUP BY 1)
SELECT i.id, CASE WHEN c.id IS NOT NULL AND NOT sent THEN c.views ELSE i.views END AS views, strftime(CASE WHEN NOT sent THEN seen END, '%Y-%m-%d %H:%M:%S') AS engagement FROM items i LEFT JOIN c USING (id)""")
def _(v):
    n = v.table("documents").count()
    counters = v.table("events").select((F.col("event_id") % F.lit(n)).alias("id"), F.floor("value").cast("bigint").alias("views"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("seq"))
    return state.refresh_counters(v.posts, counters).select("id", "views", clock.stamp(F.col("engagement_at")).alias("engagement"))


@plan("bookmarks", "SELECT s.id, greatest(last_message_id, (SELECT max(id) FROM items i WHERE i.source_id = s.id)) AS last_message_id FROM sources s")
def _(v):
    polled = v.posts.select("source_id", F.col("id").alias("message_no"))
    return state.advance_bookmarks(v.sources, polled).select("id", "last_message_id")


@plan("revive_feeds", "SELECT name FROM sources WHERE type = 'rss' AND status = 'error' AND fail_count < 5")
def _(v):
    return state.revive_feeds(v.sources, 5).select("name")


@plan("remove_source", "SELECT word_id, source_id FROM kept_rule_sources WHERE NOT (source_id = 2 AND word_id IN (SELECT word_id FROM kept_rule_sources WHERE source_id <> 2))")
def _(v):
    return state.remove_source_rules(v.kept_rule_sources, 2)


@plan("move_category", "SELECT DISTINCT word_id, CASE WHEN category = 'feed' THEN 'tech' ELSE category END AS category FROM kept_rule_categories")
def _(v):
    return state.move_category(v.kept_rule_categories, "feed", "tech")


@plan("reassign_source", "SELECT id, CASE WHEN source_id = 3 AND NOT sent THEN 'feed' ELSE category END AS category FROM items")
def _(v):
    return state.reassign(v.posts, 3, "feed").select("id", "category")


@plan("place_at_bottom", "SELECT id, coalesce((SELECT max(sort_order) FROM sources o WHERE o.category = s.category AND o.id <> s.id), -1) + 1 AS bottom FROM sources s")
def _(v):
    return state.place_at_bottom(v.sources).select("id", "bottom")


@plan("renumber_order", """, r AS (SELECT id, name, category, row_number() OVER (PARTITION BY category ORDER BY sort_order, name) - 1 AS place FROM sources), x AS (SELECT category, place FROM r WHERE name IN ('src6', 'src1'))
SELECT r.id, CASE WHEN r.place = x.place AND x.place > 0 THEN r.place - 1 WHEN r.place = x.place - 1 THEN r.place + 1 ELSE r.place END AS new_order FROM r LEFT JOIN x USING (category)""")
def _(v):
    return state.moved_up(v.sources, ["src6", "src1"]).select("id", "new_order")


@plan("toggle_links", """, t AS (SELECT DISTINCT k AS word_id, (user_id + 3) % 20 AS source_id FROM keyed_events WHERE event_type = 'purchase')
(SELECT * FROM kept_rule_sources EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM kept_rule_sources)""")
def _(v):
    toggled = v.keyed_events.filter("event_type = 'purchase'").select(F.col("k").alias("word_id"), ((F.col("user_id") + 3) % 20).alias("source_id")).distinct()
    return state.toggle(v.kept_rule_sources, toggled, ["word_id", "source_id"])


@plan("delivery_prefix", "SELECT conv_id AS digest, turn AS seq FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations f WHERE f.conv_id = c.conv_id AND f.turn <= c.turn AND length(f.text) % 4 = 0)")
def _(v):
    messages = v.table("conversations").select(F.col("conv_id").alias("digest"), F.col("turn").alias("seq"), (F.length("text") % 4 != 0).alias("ok"))
    return state.delivered(messages).select("digest", "seq")
