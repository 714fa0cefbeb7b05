"""A digest from its decisions to its messages."""

import re

from pyspark.sql import functions as F

from newsloom.operators import assemble, digest

NOW = "2024-03-02 18:00:00"
POST = "id long, digest long, category string, source_id long, source_name string, source_sort_order int, summary string, raw_text string, original_url string, published_at string, message_id string, duplicate_of long"


def posts(spark, rows):
    base = {"digest": 1, "category": "feed", "source_sort_order": 0, "raw_text": "raw", "published_at": "2024-03-02 10:00:00", "duplicate_of": None}
    names = [c.split()[0] for c in POST.split(", ")]
    full = [base | {"original_url": f"u{r['id']}", "message_id": f"m{r['id']}", "source_name": f"S{r['source_id']}"} | r for r in rows]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], POST)
    return df.withColumn("published_at", F.col("published_at").cast("timestamp")).withColumn("processed_at", F.col("published_at"))


def test_a_digest(spark):
    shown = posts(spark, [
        {"id": 1, "source_id": 1, "summary": "Council adopts the budget", "published_at": "2024-03-02 08:00:00"},
        {"id": 2, "source_id": 1, "summary": "Council adopts the budget again", "published_at": "2024-03-02 09:00:00"},  # one line with 1
        {"id": 3, "source_id": 1, "summary": "An answer to the first"},  # under 1
        {"id": 4, "source_id": 2, "summary": "Drones over <town>", "published_at": "2024-03-01 23:30:00"}, {"id": 5, "source_id": 1, "summary": "Strike at night"}, {"id": 6, "source_id": 2, "summary": "All strikes of the night"},  # one block
        {"id": 7, "source_id": 3, "category": "unheard", "summary": "Elsewhere", "source_name": None}, {"id": 8, "source_id": 2, "category": "tech", "summary": "A new chip"},
    ])
    gone = posts(spark, [{"id": 20, "source_id": 3, "summary": "Budget adopted"}, {"id": 21, "source_id": 3, "summary": "Old story", "published_at": "2024-03-01 10:00:00"}])
    store = shown.unionByName(gone)
    sources = spark.createDataFrame([(i, f"S{i}", 0) for i in (1, 2, 3)], "id long, name string, sort_order int")
    now = F.lit(NOW).cast("timestamp")
    clusters = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    updates = spark.createDataFrame([(8, 21)], "id long, shown_id long")
    hidden = spark.createDataFrame([(20, 1)], "id long, primary_id long")
    lines = assemble.merged(shown, clusters, updates, store)
    links = assemble.told_elsewhere(lines, hidden, store, sources)
    replies = spark.createDataFrame([(3, "m1"), (8, "m21")], "id long, reply_to string")
    threads = assemble.threaded(lines, digest.reply_parents(replies, store, shown), store, now)
    folded = spark.createDataFrame([(1, 6, 1), (1, 4, 2), (1, 5, 3)], "digest long, id long, place int")
    blocked = posts(spark, [{"id": 30, "source_id": 1, "summary": "Buy now"}, {"id": 31, "source_id": 1, "summary": "Licensed"}, {"id": 32, "source_id": 1, "summary": "Licensed too"}]).join(
        spark.createDataFrame([(30, "Adverts: of shops", "Adverts…"), (31, "= licensed", None), (32, "= other", None)], "id long, rule string, title string"), "id")
    categories = spark.createDataFrame([("feed", "📰", 1), ("tech", "💻", 2)], "name string, emoji string, place int")
    told = assemble.rows(threads, links, folded, blocked, categories, now, F.lit(True))
    issues = spark.createDataFrame([(1, 62, 8, "<b>Digest</b>")], "digest long, issue int, items long, title string")
    got = assemble.messages(told, issues).collect()
    assert [r.seq for r in got] == [1] and sorted(got[0].item_ids) == [1, 2, 3, 4, 5, 6, 7, 8]
    text = got[0].text
    told = re.sub("</?a[^>]*>", "", text)
    order = ["<b>Digest</b>", "F E E D", "🌙 War overnight · 3", "All strikes", "Drones", "Strike at", "<b>S1</b>", "adopts the budget again", "An answer", "T E C H", "chip", "U N H E A R D", "<b>Unknown</b>", "Filtered", "Adverts… · 1", "Buy", "= exact phrases · 2", "end #62 · 8 items"]
    assert [told.index(x) for x in order] == sorted(told.index(x) for x in order), told
    assert '<a href="u20">S3</a>' in text and "· S2</i>" in text and "&lt;town&gt;" in text and "Licensed" not in text
    assert '<i>↻ earlier: <a href="u1">09:00</a></i>' in text  # in the digest's zone
    assert '  <i>↳ 11:00</i>  ' in text and '<i>↻ earlier: <a href="u21">yday 11:00</a></i>' in text
    assert '<i>↳ to <a href="u21">yday 11:00</a> Old story</i>' in text


def test_nothing_to_show(spark):
    none = posts(spark, [{"id": 1, "source_id": 1, "summary": "x"}]).limit(0)
    empty = spark.createDataFrame([], "id long, component long")
    lines = assemble.merged(none, empty, spark.createDataFrame([], "id long, shown_id long"), none)
    assert lines.count() == 0


def test_the_block_of_quiet_sources(spark):
    from newsloom.operators import assemble

    rows = [(1, "a.b & <c>", "rss", "https://x.org/?a=\"1\"&b", "2024-01-01 00:00:00", 170), (2, "Two", "telegram", "@two", None, None), (3, "3. Three", "telegram", "-100123", "2023-12-30 00:00:00", 200)]
    silent = spark.createDataFrame(rows, "id long, name string, type string, url string, last_item_at string, hours_silent long").withColumn("last_item_at", F.col("last_item_at").cast("timestamp"))
    assert assemble.silent_block(silent).first().text == (
        "<blockquote expandable><b>💤 Quiet sources</b> (5+ days without new items)\n• <a href=\"https://t.me/two\">Two</a> — never\n• 3. Three — 8d\n"
        "• <a href=\"https://x.org/?a=&quot;1&quot;&amp;b\">a.⁠b &amp; &lt;c&gt;</a> — 7d</blockquote>"
    )
    assert assemble.silent_block(silent.limit(0)).first().text == ""
