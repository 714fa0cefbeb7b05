"""Feeds in any encoding, and a stream that knows where it was with each feed."""

import pytest

from newsloom.sources.feed_stream import FeedReader, FeedSource
from newsloom.sources.feeds import entries_of, read_feeds, tail


def feed(*links, head=""):
    return head + "<rss><channel>" + "".join(f"<item><title>Ж{k}</title><link>{k}</link></item>" for k in links) + "</channel></rss>"


def put(folder, name, number, body, file="a.xml"):
    place = folder / f"feed={name}" / f"snapshot={number}"
    place.mkdir(parents=True, exist_ok=True)
    (place / file).write_bytes(body if isinstance(body, bytes) else body.encode())


def test_declared_encodings(spark, tmp_path):
    for name in ("windows-1251", "koi8-r", "utf-16", "utf-8", "iso-8859-5"):
        (tmp_path / f"{name}.xml").write_bytes(feed(1, head=f'<?xml version="1.0" encoding="{name}"?>').encode(name))
    (tmp_path / "bom.xml").write_bytes(b"\xef\xbb\xbf\n" + feed(1).encode())
    (tmp_path / "wrong.xml").write_bytes(feed(1, head='<?xml version="1.0" encoding="no-such"?>').encode())
    (tmp_path / "bytes.xml").write_bytes(feed(1).encode("windows-1251"))
    (tmp_path / "blank.xml").write_bytes(b" ")
    got = {r.file.rsplit("/", 1)[1]: r for r in read_feeds(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 9
    for name, r in got.items():
        if name in ("wrong.xml", "bytes.xml", "blank.xml"):
            assert r.error and r.link is None
        else:
            assert (r.title, r.link, r.error) == ("Ж1", "1", None), name
    assert entries_of(feed(3))[0]["link"] == "3"


def test_offsets_are_bookmarks(tmp_path):
    reader = FeedReader({"path": str(tmp_path), "slices": "2"})
    assert reader.initialOffset() == {} == reader.latestOffset() and FeedReader({"path": str(tmp_path / "none")}).latestOffset() == {}
    put(tmp_path, "a", 0, feed(1, 2))
    put(tmp_path, "b", 3, feed(7), "x.xml")
    put(tmp_path, "b", 3, feed(8), "y.xml")
    put(tmp_path, "b", 3, "unfinished", "_temporary")
    first = reader.latestOffset()
    assert first == {"a": 0, "b": 3}
    rows = [r for p in reader.partitions({}, first) for r in reader.read(p)]
    assert sorted((r[0], r[1], r[2], r[3]) for r in rows) == [("a", 0, 0, "1"), ("a", 0, 1, "2"), ("b", 3, 0, "7"), ("b", 3, 1, "8")]
    put(tmp_path, "a", 1, b"<rss><item>")
    put(tmp_path, "a", 5, feed(9))
    put(tmp_path, "c", 0, feed(4))
    second = reader.latestOffset()
    assert second == {"a": 5, "b": 3, "c": 0}
    rows = [r for p in reader.partitions(first, second) for r in reader.read(p)]
    assert sorted((r[0], r[1], r[3], bool(r[-1])) for r in rows) == [("a", 1, None, True), ("a", 5, "9", False), ("c", 0, "4", False)] or len(rows) == 3
    assert [s for p in reader.partitions(second, second) for s in p.snapshots] == []
    assert [s[:2] for p in reader.partitions(first, first | {"a": 1}) for s in p.snapshots] == [("a", 1)]  # a batch that is read again reads the same


def test_a_snapshot_that_is_gone_is_an_error_row(tmp_path):
    reader = FeedReader({"path": f"file://{tmp_path}"})
    put(tmp_path, "a", 0, feed(1))
    put(tmp_path, "b", 0, feed(2))
    (part, *more) = reader.partitions({}, reader.latestOffset())
    (tmp_path / "feed=a" / "snapshot=0" / "a.xml").unlink()
    rows = {r[0]: r for p in (part, *more) for r in reader.read(p)}
    assert rows["a"][-1].startswith("FileNotFoundError") and rows["b"][3] == "2"


def test_slices_are_even(tmp_path):
    for k in range(40):
        put(tmp_path, f"f{k}", 0, feed(*range(1 + 40 * (k == 0))))
    parts = FeedReader({"path": str(tmp_path), "slices": "8"}).partitions({}, {f"f{k}": 0 for k in range(40)})
    assert len(parts) == 8 and sorted(len(p.snapshots) for p in parts)[0] == 1 and sum(len(p.snapshots) for p in parts) == 40


@pytest.mark.parametrize("polls", [1, 3])
def test_a_restart_goes_on_where_each_feed_was(spark, tmp_path, polls):
    spark.dataSource.register(FeedSource)
    path, out, place = (str(tmp_path / n) for n in ("feeds", "out", "checkpoint"))
    for k in range(3):
        put(tmp_path / "feeds", "a", k, feed(k))
        if k:
            put(tmp_path / "feeds", "b", k, "<broken" if k == 1 else feed(10 + k))
        if k % polls == 0 or k == 2:
            stream = spark.readStream.format("newsloom_feeds").option("path", path).load()
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.feed, r.snapshot, r.link or "") for r in rows) == [("a", 0, "0"), ("a", 1, "1"), ("a", 2, "2"), ("b", 1, ""), ("b", 2, "12")]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_logs_are_read_from_their_ends(tmp_path, block):
    import os

    texts = {"a.log": "one\ntwo\r\n\nvier é\n", "b.log": "", "c.log": "last without end", "d.log": "\n\nx\n\n"}
    for k, (name, text) in enumerate(texts.items()):
        (tmp_path / name).write_bytes(text.encode())
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
        expect = text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []
        for n in (0, 1, 2, 10):
            assert tail(None, str(tmp_path / name), n, block=block) == expect[len(expect) - min(n, len(expect)) :]
    assert tail(None, f"file://{tmp_path}", 6, block=block) == ["vier é", "last without end", "", "", "x", ""]
    assert tail(None, f"file://{tmp_path}", 6, most=6, block=block) == ["", "", "x", ""]


def test_bundles_hold_many_feeds(spark, tmp_path):
    """Files and bookmarks are those of bundles; each document is a feed of its own."""
    spark.dataSource.register(FeedSource)
    path, out, place = (str(tmp_path / n) for n in ("feeds", "out", "checkpoint"))
    for k in range(2):
        rows = [(str(f), "<rss><item>" if (f, k) == (3, 1) else feed(f * 10 + k, f * 10 + k), f % 4, k) for f in range(50)]
        spark.createDataFrame(rows, "feed string, document string, bundle int, snapshot int").repartition("bundle").write.mode("append").partitionBy("bundle", "snapshot").json(path)
        put(tmp_path / "feeds", "2", k, feed(7000 + k))
        stream = spark.readStream.format("newsloom_feeds").option("path", path).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    assert FeedReader({"path": path}).latestOffset() == {"2": 1, **{f"bundle={b}": 1 for b in range(4)}}
    got = sorted((r.feed, r.snapshot, r.link or "", r.error is not None) for r in spark.read.parquet(out).collect())
    expect = [(str(f), k, str(f * 10 + k), False) for f in range(50) for k in range(2) for _ in range(2) if (f, k) != (3, 1)] + [("3", 1, "", True), ("2", 0, "7000", False), ("2", 1, "7001", False)]
    assert got == sorted(expect)


def test_odd_lines_of_a_bundle_are_error_rows(tmp_path):
    import json

    lines = [json.dumps({"feed": "a", "document": feed(1)}), "{", json.dumps({"feed": "b"}), json.dumps({"feed": "c", "document": None}), "7", json.dumps({"feed": "d", "document": feed("é")}, ensure_ascii=False)]
    place = tmp_path / "bundle=x" / "snapshot=0"
    place.mkdir(parents=True)
    (place / "a.json").write_text("\n".join(lines))
    reader = FeedReader({"path": str(tmp_path)})
    (part,) = reader.partitions({}, reader.latestOffset())
    rows = list(reader.read(part))
    assert [(r[0], r[3], r[-1] is not None) for r in rows] == [("a", "1", False), ("bundle=x", None, True), ("b", None, True), ("c", None, True), ("bundle=x", None, True), ("d", "é", False)]
    (place / "a.json").unlink()
    assert [(r[0], r[-1][:17]) for r in reader.read(part)] == [("bundle=x", "FileNotFoundError")]
