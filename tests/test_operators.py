import importlib
import sys

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.operators import dedup, digest, graph, judge, merge, render, reposts, rules, similarity, state, triage


def test_components_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 10, 11, 12, 13, 14)], "id long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    pointers = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 5), (8, 8)], "id long, to long")
    got = {r.id: r.last for r in graph.follow(pointers).collect()}
    assert (got[1], got[2], got[3]) == (4, 4, 4) and got[5] == got[6] == 5 and 8 not in got


def at(cos):
    return [cos, (1 - cos * cos) ** 0.5]


def test_pairs_clear_their_floor(spark):
    rows = [(1, 1, "a", at(1.0)), (2, 2, "a", at(0.87)), (3, 3, "b", at(0.87)), (4, 4, "b", at(0.91)), (5, 1, "a", at(0.99)), (6, 6, "a", [0.0, 0.0]), (7, 7, "a", [1.0])]
    items = spark.createDataFrame([Row(id=i, source_id=s, category=c, digest=0) for i, s, c, _ in rows])
    vectors = spark.createDataFrame([Row(id=i, v=v) for i, _, _, v in rows], "id long, v array<float>")
    pairs = {(r.a, r.b) for r in similarity.digest_pairs(similarity.embedded(items, vectors), 0.86, 0.90).collect()}
    assert {(1, 2), (1, 4)} <= pairs and (1, 3) not in pairs and (1, 5) not in pairs and not any(6 in p or 7 in p for p in pairs)


def ladder(spark, verdict, score=0.9, shown=False, same=True, richness=0, primary=0, night=False):
    asked = spark.createDataFrame([Row(id=2, primary_id=1, score=score, shown=shown, same_category=same, richness=richness, primary_richness=primary, other_night=night)], "id long, primary_id long, score double, shown boolean, same_category boolean, richness int, primary_richness int, other_night boolean")
    table = judge.TableJudge(spark.createDataFrame([(1, 2, verdict)], "a long, b long, verdict string"))
    return dedup.confirm(asked, table if verdict != "down" else judge.NullJudge(), 0.90, 0.94, 0.95).first().outcome


@pytest.mark.parametrize(("how", "outcome"), [
    ({"verdict": "different"}, "hidden"), ({"verdict": "different", "same": False}, "kept"), ({"verdict": "same", "score": 0.87}, "hidden"), ({"verdict": "different", "richness": 2}, "kept"),
    ({"verdict": "update", "score": 0.87}, "hidden"), ({"verdict": "update", "score": 0.87, "richness": 2}, "kept"), ({"verdict": "update", "shown": True}, "update"), ({"verdict": "update", "shown": True, "score": 0.96, "richness": 1}, "hidden"),
    ({"verdict": "same", "shown": True, "night": True}, "kept"), ({"verdict": "down", "score": 0.87}, "kept"), ({"verdict": "same", "score": None}, "hidden"), ({"verdict": "nonsense", "score": None}, "kept"),
])
def test_ladder(spark, how, outcome):
    assert ladder(spark, **how) == outcome


def test_a_judge_that_raises_leaves_posts_shown(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    asked = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")

    def ask(pairs):
        if any(b == "c" for _, b in pairs):
            raise RuntimeError("down")
        return ["same"] * len(pairs)

    got = {(r.a, r.b): r.verdict for r in judge.CallableJudge(texts, ask, batch=1).pairs(asked).collect()}
    assert got == {(1, 2): "same", (1, 3): None}


def test_signatures_and_reposts(spark):
    sign = "Subscribe\n📸 Send news"
    posts = [(i, 1, f"Body number {i} " + "long enough text " * 8 + f"\n{sign}") for i in range(6)] + [(10 + i, 2, "Threat: drones\nKyiv region") for i in range(8)] + [(20, 1, f"Body number 3 {'long enough text ' * 8}")]
    df = spark.createDataFrame([Row(id=i, source_id=s, raw_text=t) for i, s, t in posts])
    found = reposts.footers(df, least=5, rounds=3)
    assert {(r.source_id, r.line) for r in found.collect()} == {(1, "Subscribe"), (1, "📸 Send news")}
    keyed = reposts.with_keys(df, found).select("id", "source_id", "key", F.lit("2024-01-01").cast("timestamp").alias("moment"), F.lit(False).alias("hidden"), F.lit(False).alias("pool"))
    assert [(r.id, r.earlier_id) for r in reposts.exact_reposts(keyed).collect()] == [(20, 3)]
    assert reposts.strip_known(spark.createDataFrame([Row(id=1, source_id=1, lines=["Subscribe"])]), found).first().lines == ["Subscribe"]


@pytest.mark.parametrize(("rule", "text", "hit"), [
    ("📣 - реклама", "📣➖реклама", True), ("📣 - реклама", "x 📣–  реклама y", True), ("п'ять", "П’ЯТЬ", True), ("", "anything", False), ("➖➖➖", "a-b", False), ("➖➖➖", "a ➖➖➖ b", True),
    ("a.b", "axb", False), ("two  words", "Two\nwords", True), ("straße", "STRASSE", True), ("[x] (y)", "[X] (Y)", True),
])
def test_literal_rules(spark, rule, text, hit):
    items = spark.createDataFrame([Row(id=1, raw_text=text, category="a", source_id=1)])
    table = spark.createDataFrame([Row(word_id=1, rule=f"= {rule}", label=None, categories=[], source_ids=[])], "word_id long, rule string, label string, categories array<string>, source_ids array<long>")
    assert (rules.literal_hits(items, table).first().hit is not None) == hit


def test_merged_line_and_links(spark):
    rows = [(1, "old", "u1", "2024-01-01 00:00:00"), (2, "", "u2", "2024-01-02 08:00:00"), (3, "mid", None, "2024-01-02 09:00:00"), (4, "same moment", "u4", "2024-01-02 08:00:00"), *[(10 + i, "x", f"v{i}", f"2024-01-02 0{i}:00:00") for i in range(5)]]
    df = spark.createDataFrame([Row(component=1, id=i, summary=s, original_url=u, published_at=t) for i, s, u, t in rows], "component long, id long, summary string, original_url string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    line = merge.earlier_links(merge.merged_lines(df)).first()
    assert (line.url, line.moment, line.summary) == ("u4", "2024-01-02 08:00:00", "mid")
    assert [x.url for x in line.shown] == ["u1", "v2", "v3", "v4"] and line.more == 2


def test_threads_and_loops(spark):
    lines = [(1, 1, 1, None), (1, 2, 2, 5), (1, 3, 3, 1), (1, 4, 4, 3), (1, 5, 5, 99), (1, 6, 6, 7), (1, 7, 7, 6), (1, 8, 8, 1), (2, 1, 1, None), *[(3, i, i, i - 1 if i else None) for i in range(140)]]
    df = spark.createDataFrame(lines, "digest long, id long, position long, parent long")
    got = digest.threads(df).orderBy("digest", "place").collect()
    assert [(r.id, r.nested) for r in got if r.digest == 1] == [(1, False), (3, True), (4, True), (8, True), (5, False), (2, True), (6, False), (7, False)]
    assert [r.id for r in got if r.digest == 3] == list(range(140))
    assert digest.threads(df.limit(0)).count() == 0


def test_ingest_stores_once_over_restarts(spark, tmp_path):
    from newsloom.streaming import ingest

    folder, store = tmp_path / "in", str(tmp_path / "store")
    def arrive(ids):
        rows = spark.createDataFrame([(i, i % 7, f'{{"k": {i}}}') for i in ids], "event_id long, user_id long, props string")
        rows.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "user_id", "'view' as event_type", "1.0D as value", "props").write.mode("append").parquet(str(folder))

    for checkpoint, ids in (("a", range(20)), ("a", range(10, 30)), ("b", range(25, 35))):
        arrive(ids)
        ingest.ingest(ingest.posts_stream(spark, str(folder), "*.parquet"), store, str(tmp_path / checkpoint))
    rows = [r.message_id for r in spark.read.parquet(store).collect()]
    assert len(rows) == len(set(rows)) == 35


def test_packing():
    blocks = render.source_blocks("N", [(1, "a" * 30), (2, "b" * 30), (3, "c" * 30)], limit=110)
    assert [ids for _, ids in blocks] == [[1, 2], [3]] and all(len(t) <= 110 for t, _ in blocks)
    body = lambda n: ("<blockquote>" + "x" * n, [n])
    out = render.split_messages([("A", []), body(50), ("B", []), body(60)], limit=80)
    assert [ids for _, ids in out] == [[50], [60]] and out[1][0].startswith("B")
    assert [ids for _, ids in render.split_messages([body(10)])] == [[10]] and render.split_messages([]) == []
    done = render.decorated(out, 5, 2)
    assert done[0][0].startswith("<b>Digest #5</b>") and done[1][0].startswith("<i>#5 · 2/2</i>") and done[1][0].endswith("2 items</i>")
    assert render.line_of("Fed cut rates", "https://e.org/?a&b") == '• <a href="https://e.org/?a&amp;b">Fed cut</a> rates' and render.line_of(" ", "u") == ""


def test_state_changes_on_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, source_id long, sent boolean, duplicate_of long, processed_at timestamp, blocked_reason string, message_id string")
    assert state.mark_duplicates(empty, spark.createDataFrame([], "id long, primary_id long")).count() == 0
    assert state.prune(empty, F.lit("2024-01-01").cast("timestamp"), 1).count() == 0
    assert state.insert_or_ignore(empty, empty, "message_id", [F.col("id")]).count() == 0


def test_entry_points_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("newsloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("newsloom.llm", "newsloom.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    import newsloom

    monkeypatch.delattr(newsloom, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "stats_by_source" in names and not any(n.startswith("op1") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_stream_keeps_late_and_undated_posts(spark, tmp_path):
    """Four polls: young, repeated, two months late, without a time; then a restart that has lost its checkpoint."""
    from newsloom.streaming import ingest

    folder, store = str(tmp_path / "in"), str(tmp_path / "store")

    def arrive(rows):
        df = spark.createDataFrame([(i, i % 7, f'{{"k": {i}}}', t) for i, t in rows], "event_id long, user_id long, props string, t string")
        df.selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "props").coalesce(1).write.mode("append").parquet(folder)

    polls = [[(1, "2024-03-01 10:00:00"), (2, "2024-03-01 11:00:00")], [(2, "2024-03-01 11:00:00"), (3, None), (3, "2024-03-02 09:00:00")], [(4, "2024-01-01 00:00:00")], [(5, None), (5, None)], [(6, "2024-03-02 12:00:00")]]
    now = F.lit("2024-03-02 12:00:00").cast("timestamp")
    for k, rows in enumerate(polls):
        arrive(rows)
        ingest.ingest(ingest.posts_stream(spark, folder, "*.parquet"), store, str(tmp_path / ("a" if k < 4 else "b")), now)
    got = {r.message_id.rsplit("_", 1)[1]: (r.late, str(r.published_at)) for r in spark.read.parquet(store).collect()}
    assert spark.read.parquet(store).count() == 6
    assert got == {"1": (False, "2024-03-01 10:00:00"), "2": (False, "2024-03-01 11:00:00"), "3": (False, "2024-03-02 09:00:00"), "4": (True, "2024-01-01 00:00:00"), "5": (False, "None"), "6": (False, "2024-03-02 12:00:00")}


def test_a_batch_that_is_written_again_is_there_once(spark, tmp_path):
    from newsloom.streaming import ingest

    folder, store, place = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "c")
    rows = spark.createDataFrame([(i, i, f'{{"k": {i}}}') for i in range(5)], "event_id long, user_id long, props string")
    rows.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "user_id", "'view' as event_type", "1.0D as value", "props").write.parquet(folder)
    ingest.ingest(ingest.posts_stream(spark, folder, "*.parquet"), store, place)
    import shutil

    shutil.rmtree(f"{place}/commits")  # written, but not committed: the batch runs again
    ingest.ingest(ingest.posts_stream(spark, folder, "*.parquet"), store, place)
    assert spark.read.parquet(store).count() == 5


def test_tiles_change_nothing(spark, monkeypatch):
    import random

    rng = random.Random(2)
    items = spark.createDataFrame([Row(id=i, digest=i % 2, source_id=i % 5, category="ab"[i % 2], processed_at=f"2024-01-0{1 + i % 4} 0{i % 9}:00:00") for i in range(60)]).withColumn("processed_at", F.col("processed_at").cast("timestamp"))
    rows = similarity.embedded(items, spark.createDataFrame([Row(id=i, v=[rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id long, v array<float>"))

    def every():
        pairs = {(r.a, r.b, round(r.score, 6)) for r in similarity.digest_pairs(rows, 0.3, 0.5).collect()}
        own = {(r.a, r.b) for r in similarity.digest_pairs(rows, 0.2, 0.2, within_source=True).collect()}
        best = {(r.id, r.best_id, r.follow_id) for r in similarity.pool_matches(rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0"), 48, 0.3, 0.5, 0.9).collect()}
        return pairs, own, best

    whole = every()
    monkeypatch.setattr(similarity, "TILE", 4)
    assert every() == whole and all(whole)


def test_folds_hold_one_state(spark):
    from newsloom.operators.fold import folded

    rows = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in range(40)], "key string, i long").repartition(3)
    out = folded(rows, "key", ["i"], lambda s, r: ((s or 0) + r["i"], {"key": r["key"], "n": (s or 0) + r["i"]} if r["i"] % 20 == 0 else None), "key string, n long", lambda key, s: {"key": key, "n": -s})
    assert sorted((r.key or "", r.n) for r in out.collect()) == sorted((k, n) for k in ("a", "", "b") for n in (0, 210, -780))
    assert folded(rows.limit(0), "key", ["i"], lambda s, r: (s, None), "key string, n long", lambda k, s: {}).count() == 0


def test_templates_are_never_sorted(spark):
    posts = spark.createDataFrame([(i, 1, "k" * 120 if i < 50 else f"{'x' * 110}{i // 2}", f"2024-01-01 00:00:{i % 60:02}", False, False) for i in range(60)], "id long, source_id long, key string, moment string, hidden boolean, pool boolean")
    assert {(r.id, r.earlier_id) for r in reposts.exact_reposts(posts).collect()} == {(i, i - 1) for i in range(51, 60, 2)}


def test_shown_rules_without_a_join(spark):
    chunks = spark.createDataFrame([Row(digest=1, chunk=0, id=1, category="a", source_id=1), Row(digest=1, chunk=0, id=2, category=None, source_id=2), Row(digest=1, chunk=1, id=3, category="b", source_id=9)], "digest long, chunk long, id long, category string, source_id long")
    known = spark.createDataFrame([(1, "= x", [], []), (2, "all", [], []), (3, "other", ["other"], []), (4, "b at 9", ["b"], [9]), (5, "b at 1", ["b"], [1])], "word_id long, rule string, categories array<string>, source_ids array<long>")
    got = rules.shown_rules(chunks, known)
    assert {tuple(r) for r in got.collect()} == {(1, 0, 2), (1, 0, 3), (1, 1, 2), (1, 1, 4)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_of_posts():
    line = render.post_line
    assert line({"summary": "Fed cut rates", "url": "https://e.org", "phrase": "cut rates", "at": "10:05"}) == '<i>10:05</i>  Fed <a href="https://e.org">cut rates</a>'
    assert line({"summary": "[Photo]", "url": "u", "note": "×3"}) == '<a href="u">📷 Photo ×3</a>' and line({"summary": "[Video] Words here", "url": None, "note": "1:05"}) == "🎬 1:05 Words here"
    assert line({"summary": "", "url": "u"}) == '<a href="u">→</a>' and line({"summary": " ", "url": None}) == ""
    full = line({"summary": "A <b> c", "url": None, "at": "09:00", "nested": True, "deleted": True, "votes": 7, "links": [("X & Y", "x"), ("Z", None)], "earlier": [("08:00", "e")], "more": 2, "reply": ("07:00", "r", "what & why")})
    assert full == '  <i>↳ 09:00</i>  🗑 A &lt;b&gt; c <i>· ▲ 7</i> <i>(<a href="x">X &amp; Y</a>)</i>\n<i>↳ to <a href="r">07:00</a> what &amp; why</i>\n<i>↻ earlier: +2 · <a href="e">08:00</a></i>'
    assert line({"summary": "S", "url": None, "via": "a.b", "links": [("C", "c")]}) == 'S <i>· a.⁠b, <a href="c">C</a></i>'


def test_filling_is_greedy():
    import random

    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randint(0, 12) for _ in range(rng.randint(0, 14))]
        joints = [rng.randint(0, 3) for _ in sizes]
        room = rng.randint(1, 20)
        got = [list(range(len(sizes)))[p] for p in render.fill(sizes, joints, room)]
        assert [i for p in got for i in p] == list(range(len(sizes)))
        long = lambda p: sum(sizes[i] for i in p) + sum(joints[i] for i in p[1:])
        for p, after in zip(got, [*got[1:], None][: len(got)], strict=True):
            assert len(p) == 1 or long(p) <= room
            assert after is None or long([*p, after[0]]) > room


def test_messages_keep_headings_with_their_quotes():
    quote = lambda n, i: ("<blockquote>" + "x" * (n - 12), [i])
    out = render.split_messages([("\nA", []), quote(40, 1), ("\nB", []), quote(40, 2), quote(20, 3), ("\nC", []), quote(95, 4), ("tail", [])], limit=96)
    assert [ids for _, ids in out] == [[1, 2], [3], [4], []] and out[0][0].startswith("A") and out[1][0].endswith("C") and all(len(t) <= 96 for t, _ in out)
    around = render.Frame(7, 1, "<b>T</b>")
    done = around.around([("x" * (render.MESSAGE_LIMIT - around.room), [1])] * 3)
    assert all(len(t) <= render.MESSAGE_LIMIT for t, _ in done) and done[2][0].endswith("1 item</i>") and done[0][0].startswith("<b>T</b>\n\n")


def test_rewrites_are_kept_if_they_bring_in_less(spark):
    from newsloom.operators import triage

    answers = spark.createDataFrame([(1, "two died", "4 died", "2 died"), (2, "two died", "4 died", "5 died"), (3, "two died", "2 died", "nobody"), (4, "two died", "4 and 5 died", "4 died"), (5, "two died", "4 died", None), (6, None, None, None)], "id long, source string, summary string, rewrite string")
    got = {r.id: (r.summary, r.rewritten) for r in triage.kept_rewrites(answers, 2026).collect()}
    assert got == {1: ("2 died", True), 2: ("4 died", False), 3: ("2 died", False), 4: ("4 died", True), 5: ("4 died", False), 6: (None, False)}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.shared_folder(Session)


def test_a_last_line_is_looked_up_by_its_ending_and_not_held_against_every_signature(spark):
    signs = ["x", "abc", "abcd", "one two", "a line of more than sixteen characters", "tail." * 20]
    footers = spark.createDataFrame([(1, s) for s in signs] + [(2, "abc"), (2, " "), (None, "abc")], "source_id long, line string")
    texts = ["body\nxx", "zabc", "ab\nABC", "​abcd \n", "none", "", None, "[Photo]", "[Forwarded from a] none", "none two", "say: a line of more than sixteen characters", "a line of more than sixteen character", "tail." * 19, "!" + "tail." * 20]
    posts = spark.createDataFrame([(s, 100 * (s or 9) + k, t) for s in (1, 2, 3, None) for k, t in enumerate(texts)] + [(1, None, "none"), (1, None, "none")], "source_id long, id long, raw_text string")
    out = triage.unsigned(posts, footers)
    assert out.columns == posts.columns

    def unsigned(own, text):
        raw = (text or "").strip()
        last = raw.replace("​", "").split("\n")[-1].strip()
        return raw not in ("", "[Photo]") and not raw.startswith("[Forwarded") and not any(last.endswith(s) for s in own)

    want = [(s, 100 * s + k) for s, own in ((1, signs), (2, ["abc"])) for k, t in enumerate(texts) if unsigned(own, t)] + [(1, None), (1, None)]
    assert sorted(((r.source_id, r.id) for r in out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan.lower()  # the lines of a text are not taken apart once for each signature
