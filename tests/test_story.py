import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.operators import judge, similarity, story
from newsloom.sources import feeds

ITEM = "id long, digest long, source_id long, source_type string, source_sort_order int, category string, summary string, raw_text string, published_at string, processed_at string, duplicate_of long"


def table(spark, rows):
    base = {"digest": 1, "source_type": "rss", "source_sort_order": 0, "category": "a", "summary": "s", "raw_text": "short", "published_at": "2024-01-02 10:00:00", "processed_at": "2024-01-02 10:00:00", "duplicate_of": None}
    rows = [base | r for r in rows]
    names = [c.split()[0] for c in ITEM.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ITEM).withColumn("published_at", F.col("published_at").cast("timestamp")).withColumn("processed_at", F.col("processed_at").cast("timestamp"))


def angles(spark, at):
    """Unit vectors by angle, or by plane and angle."""
    rows = []
    for i, x in at.items():
        plane, angle = x if isinstance(x, tuple) else (0, x)
        v = [0.0] * 12
        v[2 * plane : 2 * plane + 2] = [math.cos(angle), math.sin(angle)]
        rows.append(Row(id=i, v=v))
    return spark.createDataFrame(rows, "id long, v array<float>")


def run(spark, items, pool, at, verdicts):
    table_judge = judge.TableJudge(spark.createDataFrame(verdicts, "a long, b long, verdict string"))
    hidden, updates = story.deduplicate(table(spark, items), table(spark, pool), angles(spark, at), table_judge)
    return {r.id: r.primary_id for r in hidden.collect()}, {r.id: r.shown_id for r in updates.collect()}


def test_steps_of_a_digest(spark):
    deg = math.radians
    long = "The very same words of one channel, told once more without a change of any letter. " * 3
    items = [
        {"id": 1, "source_id": 1, "source_type": "telegram"}, {"id": 2, "source_id": 2}, {"id": 3, "source_id": 3},  # one event; 3 is judged different
        {"id": 10, "source_id": 1}, {"id": 11, "source_id": 2},  # all but identical
        {"id": 20, "source_id": 4}, {"id": 21, "source_id": 5},  # 20 goes on shown 100, 21 repeats shown 101
        {"id": 30, "source_id": 6},  # its own source's next development of 102
        {"id": 40, "source_id": 7, "raw_text": long},  # an exact repost of 103
    ]
    shown = {"published_at": "2024-01-02 02:00:00", "processed_at": "2024-01-02 02:00:00"}
    pool = [{"id": 100, "source_id": 8} | shown, {"id": 101, "source_id": 9} | shown, {"id": 102, "source_id": 6} | shown, {"id": 103, "source_id": 7, "raw_text": long} | shown]
    at = {1: 0.0, 2: deg(24), 3: deg(-26), 10: (1, 0.0), 11: (1, deg(0.5)), 20: (2, 0.0), 100: (2, deg(25)), 21: (3, 0.0), 101: (3, deg(1)), 30: (4, 0.0), 102: (4, deg(24))}
    hidden, updates = run(spark, items, pool, at, [(1, 2, "same"), (1, 3, "different"), (100, 20, "update"), (102, 30, "update")])
    assert hidden == {2: 1, 11: 10, 21: 101, 40: 103}
    assert updates == {20: 100, 30: 102}


def test_a_silent_judge_hides_only_what_is_certain(spark):
    items = [{"id": 1, "source_id": 1}, {"id": 2, "source_id": 2}, {"id": 3, "source_id": 3}]
    at = {1: 0.0, 2: math.radians(28), 3: math.radians(1)}
    hidden, updates = story.deduplicate(table(spark, items), table(spark, items).limit(0), angles(spark, at), judge.NullJudge())
    assert {r.id: r.primary_id for r in hidden.collect()} == {3: 1} and updates.count() == 0


def test_refused_posts_of_one_story_are_grouped(spark):
    items = [{"id": 1, "source_id": 1, "source_type": "telegram"}, {"id": 2, "source_id": 2}, {"id": 3, "source_id": 3}]
    at = {1: 0.0, 2: math.radians(26), 3: math.radians(29)}
    hidden, _ = run(spark, items, [], at, [(1, 2, "different"), (1, 3, "different"), (2, 3, "same")])
    assert hidden == {3: 2}


def test_settle(spark):
    pairs = spark.createDataFrame([(1, 5, 4, 0.99), (1, 4, 3, 0.98), (1, 6, 5, 0.97), (1, 5, 2, 0.96), (1, 8, 7, 0.9)], "digest long, id long, primary_id long, score double")
    assert {r.id: r.primary_id for r in story.settle(pairs).collect()} == {5: 4, 8: 7}


def test_vectors_are_filled_and_guarded(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, " "), (4, "bad"), (5, None)], "id long, text string")
    have = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>")

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[0.0, 1.0] for _ in texts]

    got = {r.id: r.v for r in similarity.fill_vectors(items, have, embed, batch=1).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0]}
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [0.0, 2.0])], "id long, v array<float>")
    assert {r.id for r in similarity.usual_length(mixed).collect()} == {2, 3}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<?xml version="1.0"?><rss><channel><title>No entry</title>
      <item><title>T &amp; U</title><link>https://e.org/1</link><description>&lt;p&gt;B&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate></item>
      <item><title>V</title><guid>g2</guid><pubDate>nonsense</pubDate></item></channel></rss>""")
    (tmp_path / "b.atom").write_text("""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="x"/><link href="https://e.org/3"/><updated>2024-01-02T10:00:00Z</updated><summary>S</summary></entry></feed>""")
    (tmp_path / "c.xml").write_text("<rss><item>")
    rows = feeds.read_feeds(spark, str(tmp_path)).orderBy("file", "position").collect()
    assert [(r.position, r.link, r.title, r.summary, r.published) for r in rows if r.error is None] == [(0, "https://e.org/1", "T & U", "<p>B</p>", "2024-01-02 09:00:00"), (1, "g2", "V", None, None), (0, "https://e.org/3", "A", "S", "2024-01-02 10:00:00")]
    assert [r.file.rsplit("/", 1)[1] for r in rows if r.error] == ["c.xml"]


def test_log_tail(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(f"line {i}" for i in range(100)))
    assert feeds.tail(spark, str(tmp_path / "x.log"), 3) == ["line 97", "line 98", "line 99"]
    assert feeds.tail(spark, str(tmp_path / "x.log"), 50, most=16) == ["line 98", "line 99"]


def test_client_errors(spark):
    df = spark.createDataFrame([(200,), (404,), (408,), (429,), (500,)], "s int")
    assert [r.e for r in df.select(feeds.client_error(F.col("s")).alias("e")).collect()] == [False, True, False, False, False]


def test_reposts_of_what_was_shown_before_the_digest_alone(spark):
    long = "The very same words of one channel, told once more without a change of any letter. " * 3
    at = lambda day, hour=10: {"published_at": f"2024-01-{day:02} {hour:02}:00:00", "processed_at": f"2024-01-{day:02} {hour:02}:00:00"}
    items = [{"id": 1, "source_id": 1, "raw_text": long} | at(10), {"id": 2, "source_id": 2, "raw_text": long} | at(10), {"id": 3, "source_id": 3, "raw_text": long} | at(10), {"id": 4, "source_id": 4, "raw_text": long} | at(10)]
    items += [{"id": 11, "digest": 2, "source_id": 1, "raw_text": long} | at(20)]
    pool = [{"id": 100, "source_id": 1, "raw_text": long} | at(25), {"id": 101, "source_id": 2, "raw_text": long} | at(9), {"id": 102, "source_id": 3, "raw_text": long} | at(1)]  # later, the day before, days before
    pool += [{"id": 103, "source_id": 4, "raw_text": long} | at(9), {"id": 104, "source_id": 4, "raw_text": long} | at(30)]  # no template yet
    hidden, updates = run(spark, items, pool, {}, [])
    assert hidden == {2: 101, 4: 103} and updates == {}


def test_looking_back(spark):
    rows = [(k, f"2024-01-{1 + k // 24:02} {k % 24:02}:00:00") for k in range(0, 200, 5)]
    pool = spark.createDataFrame(rows, "id long, processed_at string").withColumn("processed_at", F.col("processed_at").cast("timestamp"))
    digests = spark.createDataFrame([(1, "2024-01-03 02:00:00"), (2, "2024-01-05 00:00:00"), (3, "2023-12-31 00:00:00")], "digest long, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp"))
    for hours in (10, 24, 48):
        from newsloom.operators import reposts

        got = {(r.id, r.digest) for r in reposts.looked_back(pool, digests, hours).collect()}
        assert got == {(k, d) for k, _ in rows for d, end in ((1, 50), (2, 96), (3, -24)) if end - hours < k <= end}


def test_texts_are_taken_apart_once_and_stay_where_they_are(spark, monkeypatch):
    """One pass over each text; joins, and all steps after it, have what it tells."""
    from newsloom.functions import text
    from newsloom.operators import dedup, reposts
    from newsloom.sources.views import Views
    from tests.test_plans import SF

    plan = Views(spark, SF).items._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan.split("BroadcastHashJoin")[1]
    seen = []
    monkeypatch.setattr(dedup, "confirm", lambda asked, *a, _was=dedup.confirm: seen.append(asked) or _was(asked, *a))
    monkeypatch.setattr(reposts, "exact_reposts", lambda posts, *a, _was=reposts.exact_reposts, **k: seen.append(posts) or _was(posts, *a, **k))
    assert run(spark, [{"id": 1, "source_id": 1}, {"id": 2, "source_id": 2}], [], {1: 0.0, 2: 0.01}, []) == ({2: 1}, {})
    for df in seen:
        told = df._jdf.queryExecution().executedPlan().toString()
        assert "raw_text" not in told and "lines" not in told and text.TALLY not in told
    assert len(seen) == 5


def test_what_a_text_tells_is_the_same_in_fewer_steps(spark):
    from newsloom.functions import text
    from newsloom.operators import reposts

    odd = ["", " ", " a  b　", "\n x \r\n y \n", "[Context: q]\n body\nSign", "[Context: q] body\nSign", " [Context: q]\nz", "збил 3", "5 дрон знешкод", "збил", "ППО 7", "дрон", None]
    odd += [f"body {k}\nInner\nSign" for k in range(6)] + [f"other {k}\nInner" for k in range(3)] + ["long " * 40 + "\nInner\nSign", "Sign"]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(odd)], "id long, source_id long, raw_text string")
    once = reposts.with_lines(rows)
    raw = F.col("raw_text")
    plain = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), text.strip), lambda x: x != "")
    same = once.select((F.col("lines") == plain).alias("l"), text.collapse(raw).eqNullSafe(text.strip(F.regexp_replace(raw, r"(?U)\s+", " "))).alias("c"), (text.is_tally(raw) == F.coalesce(raw, F.lit("")).rlike(text.TALLY)).alias("t"))
    assert all(r.l and r.c and r.t for r in same.collect())
    found = reposts.footers(once.drop("raw_text"))
    assert sorted(r.line for r in found.collect()) == ["Inner", "Sign"] == sorted(r.line for r in reposts.footers(rows).collect())
    key = lambda t: {r.id: r.key for r in reposts.with_keys(t, found, 1).select("id", "key").collect()}
    assert key(once.drop("raw_text")) == key(rows)
    assert key(rows)[4] == "body" and key(rows)[6] == "z" and key(rows)[len(odd) - 2] == "long" * 40
