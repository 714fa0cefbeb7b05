"""Feed files (RSS and Atom) as entries, log files as their last lines.

Files are read by Spark's readers, so any store works, a file is one row, and a feed that can't be
parsed is a row with an error, never an exception. Feeds are parsed as bytes, in the encoding that they
declare.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "file string, position int, link string, title string, summary string, published string, error string"


#: What a document that is no feed raises: bad markup, an unknown encoding, bytes that aren't in it.
BROKEN = (ET.ParseError, LookupError, ValueError)


def entries_of(document: bytes | str) -> list[dict]:
    """Entries in the order of the feed; `published` as ISO in UTC, or None where it is no date."""
    def plain(tag: str) -> str:
        return tag.rsplit("}", 1)[-1].lower()

    out = []
    clean = document.lstrip("\ufeff \r\n\t") if isinstance(document, str) else document.removeprefix(b"\xef\xbb\xbf").lstrip(b" \r\n\t")
    for node in ET.fromstring(clean).iter():
        if plain(node.tag) not in ("item", "entry"):
            continue
        found: dict[str, str] = {}
        for child in node:
            name, value = plain(child.tag), "".join(child.itertext()).strip()
            if name == "link" and child.get("rel", "alternate") != "alternate":
                continue
            if name == "link":
                value = child.get("href") or value
            found.setdefault(name, value)
        date = found.get("pubdate") or found.get("published") or found.get("updated") or found.get("date")
        out.append({"link": found.get("link") or found.get("guid") or found.get("id"), "title": found.get("title"), "summary": found.get("description") or found.get("summary") or found.get("content"), "published": moment(date)})
    return out


def moment(value: str | None) -> str | None:
    for parse in (parsedate_to_datetime, lambda v: pd.Timestamp(v).to_pydatetime()):
        try:
            at = pd.Timestamp(parse(value))
        except (TypeError, ValueError):
            continue
        if at is not pd.NaT:
            return (at.tz_localize("UTC") if at.tzinfo is None else at.tz_convert("UTC")).strftime("%Y-%m-%d %H:%M:%S")
    return None


_ARROW = pa.schema([(n, pa.int32() if n == "position" else pa.string()) for n in (c.split()[0] for c in ENTRIES.split(", "))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, document in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows += [{"file": file, "position": i, **e} for i, e in enumerate(entries_of(document))]
            except BROKEN as problem:
                rows.append({"file": file, "error": f"{type(problem).__name__}: {problem}"})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every feed file under path, and a row with `error` of each that is none. Files without a byte have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), "content").mapInArrow(_parse, ENTRIES)


def client_error(status: Column) -> Column:
    """An answer that asking again won't change."""
    return status.between(400, 499) & ~status.isin(408, 429)


def _backwards(file: fs.NativeFile, size: int, block: int) -> Iterator[str]:
    """The lines of a file, the last one first; no more of it is read than is asked for."""
    rest, end = b"", size
    while end > 0:
        start = max(0, end - block)
        file.seek(start)
        first, *whole = (file.read(end - start) + rest).split(b"\n")
        if end == size and whole and not whole[-1]:
            whole.pop()  # the end of the last line
        for line in reversed(whole):
            yield line.decode("utf-8", "replace").removesuffix("\r")
        rest, end = first, start
    if size:
        yield rest.decode("utf-8", "replace").removesuffix("\r")


def tail(spark: SparkSession, path: str, lines: int, most: int = 4096, block: int = 64 << 10) -> list[str]:
    """The last lines of log files, as many of the newest as fit. Files are read from their ends, the newest first, block by block."""
    where, root = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path if ":/" in path else f"file://{path}"))
    there = where.get_file_info(root)
    files = [there] if there.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    out: list[str] = []
    for f in sorted(files, key=lambda f: (f.mtime_ns or 0, f.path), reverse=True):
        with where.open_input_file(f.path) as file:
            for line in _backwards(file, f.size, block):
                if len(out) == lines or sum(map(len, out)) + len(out) + len(line) > most:
                    return out[::-1]
                out.append(line)
    return out[::-1]
