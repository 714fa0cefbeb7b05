"""Text functions as column expressions; they run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as what is part of the results.
ZERO_WIDTH = "[­​-‍⁠﻿︎️]"
FILLERS = "[⠀ㅤ]"
MEDIA_TOKENS = ["[Photo]", "[Video]", "[GIF]", "[Video note]", "[Sticker]", "[Doc]", "[Audio]", "[Voice]", "[Giveaway]", "[Giveaway results]", "[Story]", "[Location]", "[Venue]", "[Contact]", "[Checklist]", "[Paid media]", "[Dice]", "[Game]", "[Invoice]", "[Media]"]
NO_TEXT_SUMMARIES = ["no text", "no caption", "media"]
NO_MERGE = ["no merge", "no_merge", "не мерджити", "не об'єднувати", "не объединять", "окремо", "separate"]
NO_FILTER = ["no filter", "no_filter", "не фільтрувати", "не блокувати", "не фільтр", "bypass filter"]
NO_TRANSLATE = ["no translate", "no_translate", "no translation", "без перекладу", "не перекладати", "keep original language"]
DASHES = "-֊־᐀᠆‐‑‒–—―⸗⸚⸺⸻⹀⹝︱︲﹘﹣－−⁃➖"
APOSTROPHES = "'‘’ʼʹ′＇`"
DESCRIPTIONS = [
    r"""(?i)<meta[^>]+property=["']og:description["'][^>]+content=(["'])((?:(?!\1)[^<>])+)\1""",
    r"""(?i)<meta[^>]+name=["']description["'][^>]+content=(["'])((?:(?!\1)[^<>])+)\1""",
    r"""(?i)<meta[^>]+name=["']twitter:description["'][^>]+content=(["'])((?:(?!\1)[^<>])+)\1""",
    r"""(?i)<meta[^>]+content=(["'])((?:(?!\1)[^<>])+)\1[^>]+property=["']og:description""",
]
SITE_WIDE = r"(?i)development by creating an account on GitHub|We.re on a journey to advance and democratize"
CONTEXT = r"^\[Context:[^\n]*\]\n"
TALLY = r"(?i)(ППО|Повітрян\w+ сил|збил|знешкоджен|знешкодил)[^.]{0,120}\d+|\d+[^.]{0,60}(дрон|БпЛА|безпілот)[^.]{0,80}(ППО|збил|знешкод)"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))  # of white space only single U+0020 are left


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value); the value is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean_invisible(text: Column) -> Column:
    """Zero-width marks vanish, blank-looking fillers are spaces."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), FILLERS, " "), ZERO_WIDTH, "")


def without_context(text: Column) -> Column:
    """Without the line that quotes the answered post."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTEXT, "")


def without_image_note(text: Column) -> Column:
    """Without what a vision model read off the picture; a context line and a forward label stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^(\[Context: [^\n]*\]\n)?(\[Forwarded from [^\]\n]*\] )?\[Image: [^\n]*\]\n", "$1$2")


def without_media_prefix(text: Column) -> Column:
    tokens = "|".join(t[1:-1] for t in [*MEDIA_TOKENS, "[Document]", "[Animation]"])
    return strip(F.regexp_replace(text, rf"(?i)^\[(?:{tokens})\]\s*", ""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))


def repost_key(body: Column, least: int = 100) -> Column:
    """Letters and digits of any script, lower-cased; empty when too short to tell a repost."""
    key = F.regexp_replace(F.lower(without_context(body)), r"(?U)\W+", "")
    return once(key, lambda k: F.when(F.length(k) >= least, k).otherwise(""))


def text_lines(text: Column) -> Column:
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.right(x, F.lit(1)))
    bare = lambda x: F.when(ends(x).rlike(r"(?U)\s"), strip(x)).otherwise(x)
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), bare), lambda x: x != "")


def richness(text: Column) -> Column:
    """How much a post itself says, in steps of 150 characters."""
    own = F.regexp_replace(F.regexp_replace(without_image_note(text), r"https?://\S+", ""), r"^\s*(\[[^\]]{0,300}\]\s*)+", "")
    return F.floor(F.length(collapse(own)) / 150).cast("int")


def is_tally(text: Column) -> Column:
    """TALLY, whose words are looked for before the pattern is tried."""
    text = F.coalesce(text, F.lit(""))
    return (text.contains("ППО") | text.contains("Повітрян") | text.contains("збил") | text.contains("знешкод")) & text.rlike(TALLY)


def is_placeholder(text: Column) -> Column:
    """Nothing an embedding could tell apart."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return t.isin(NO_TEXT_SUMMARIES) | (t.startswith("[") & t.endswith("]") & (F.length(t) <= 20))


def is_media_only(text: Column) -> Column:
    """Nothing a filter could judge."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t == "") | (t == "no text") | t.isin(MEDIA_TOKENS)


def wants(prompt: Column, keywords: list[str]) -> Column:
    """P08."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    out = F.lit(False)
    for k in keywords:
        out = out | low.contains(k)
    return out


def host_listed(url: Column, hosts: list[str]) -> Column:
    """The host itself or below it."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def compose(title: Column, body: Column) -> Column:
    """Headline and body of a feed entry, one of them if it holds the other."""
    title, body = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    return (
        F.when(title == "", body).when(body == "", title)
        .when(F.lower(body).contains(F.lower(title)), body).when(F.lower(title).contains(F.lower(body)), title)
        .otherwise(F.concat(title, F.lit(". "), body))
    )


def votes(summary: Column) -> Column:
    """T04."""
    return F.nullif(F.regexp_extract(F.coalesce(summary, F.lit("")), r"\bPoints:\s*(\d+)", 1), F.lit("")).cast("int")


def source_link(kind: Column, url: Column) -> Column:
    """T15."""
    u = strip(F.coalesce(url, F.lit("")))
    handle = F.regexp_replace(u, "^@+", "")
    return (
        F.when((kind == "telegram") & ~u.startswith("http") & (u != ""), F.when(handle.rlike(r"^\p{L}"), F.concat(F.lit("https://t.me/"), handle)))
        .when(u.startswith("http"), u)
    )


def post_link(url: Column) -> tuple[Column, Column]:
    """(channel, post number) of a link to a post; a private channel is its number."""
    peer = F.regexp_extract(url, r"^https://t\.me/(?:c/)?([^/]+)/\d+$", 1)
    number = F.regexp_extract(url, r"^https://t\.me/(?:c/)?[^/]+/(\d+)$", 1)
    return F.nullif(peer, F.lit("")), F.nullif(number, F.lit("")).cast("bigint")


def raw_channel(chat_id: Column) -> Column:
    """A channel's own number from its -100... id."""
    return F.when(chat_id <= -1000000000000, -chat_id - 1000000000000).otherwise(F.abs(chat_id))


def media_note(album: Column, seconds: Column) -> Column:
    """P20: size of an album, else length of a video."""
    time = F.when(seconds >= 3600, F.format_string("%d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))).otherwise(
        F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int")))
    return F.when(album > 1, F.concat(F.lit("×"), album.cast("string"))).when(seconds > 0, time)


def mark_cut(summary: Column, text: Column, cap: int = 700) -> Column:
    """T12."""
    bare = F.regexp_replace(summary, r"(?U)\s+$", "")
    return F.when((summary != "") & (F.length(text) > cap) & ~bare.endswith("…"), F.concat(bare, F.lit(" …"))).otherwise(summary)


def reads_as(text: Column, script: str, own: str, foreign: str, share: float = 0.4) -> Column:
    """Mostly in a script, with a letter only that language has and none it lacks; few letters pass."""
    low, n = F.lower(F.coalesce(text, F.lit(""))), letters(text)
    inside = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{script}]", ""))
    return (n < 4) | (~low.rlike(f"[{foreign}]") & (inside / F.greatest(n, F.lit(1)) >= share) & low.rlike(f"[{own}]"))


def numbers(text: Column) -> Column:
    """T20, the part in digits: the numbers a text names, thousands separators left out."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)[ ,](?=\d{3}\b)", "$1")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"(\d+(?:\.\d+)?)"), 1))


def unescape_common(text: Column) -> Column:
    """The character references that pages use most; the ampersand's own comes last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_html(text: Column) -> Column:
    """T01."""
    return collapse(F.regexp_replace(unescape_common(text), "<[^>]+>", " "))


def paragraphs(page: Column, least: int = 80) -> Column:
    """The paragraphs of a page that say something, without navigation and scripts."""
    body = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style|nav|header|footer|aside|form)[^>]*>.*?</\1>", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    clean = F.transform(found, lambda p: collapse(unescape_common(F.regexp_replace(p, "<[^>]+>", " "))))
    return F.filter(clean, lambda p: F.length(p) >= least)


def description(page: Column, least: int = 60) -> Column:
    """What the page says about itself, when that is a sentence of its own."""
    out = F.lit("")
    for pattern in DESCRIPTIONS:
        text = strip_html(F.regexp_extract(page, pattern, 2))
        good = (F.length(text) >= least) & ~text.rlike(SITE_WIDE)
        out = F.when((out == "") & good, text).otherwise(out)
    return out


def lead(page: Column) -> Column:
    own = description(page)
    return F.when(own != "", F.substring(own, 1, 600)).otherwise(F.substring(F.array_join(F.slice(paragraphs(page), 1, 2), " "), 1, 600))


def normal_for_rules(text: Column) -> Column:
    """Case, white space and invisible characters don't matter to a literal rule."""
    return F.replace(F.lower(collapse(clean_invisible(text))), F.lit("ß"), F.lit("ss"))


def clipped(label: Column, most: int = 40) -> Column:
    """A label that fits, cut between words unless that would lose half of it."""
    head = F.substring(label, 1, most - 1)
    whole = F.regexp_extract(head, rf"(?s)^(.{{{most // 2},}}) [^ ]*$", 1)
    cut = F.regexp_replace(F.when(whole != "", whole).otherwise(head), "[ ·-]+$", "")
    return F.when(F.length(label) <= most, label).otherwise(F.concat(cut, F.lit("…")))


def name_and_page(payload: Column) -> tuple[Column, Column]:
    """T28: 'name:2' read from the right, as a name may hold colons; without a number page 0."""
    page = F.regexp_extract(payload, r"(?s)^.*:([0-9]+)$", 1)
    return F.when(page != "", F.regexp_extract(payload, r"(?s)^(.*):[0-9]+$", 1)).otherwise(payload), F.coalesce(F.nullif(page, F.lit("")).cast("int"), F.lit(0))


def image_note(text: Column, most: int = 600) -> Column:
    """What a model read off a picture, as one line in brackets."""
    line = F.substring(collapse(F.translate(F.coalesce(text, F.lit("")), "[]", "()")), 1, most)
    return F.when(line == "", "").otherwise(F.concat(F.lit("[Image: "), line, F.lit("]")))


def wait_seconds(header: Column) -> Column:
    """Seconds of '2m59.5s', '1h30m' or a plain number; null for nothing."""
    parts = lambda k: F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"(\d*\.?\d+)([hms]?)"), F.lit(k))
    unit = lambda u: F.when(u == "h", 3600.0).when(u == "m", 60.0).otherwise(1.0)
    total = F.aggregate(F.zip_with(parts(1), parts(2), lambda n, u: n.cast("double") * unit(u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, total)


def is_heading(block: Column) -> Column:
    """A block of a message that quotes nothing heads those after it."""
    return ~F.coalesce(block, F.lit("")).contains("<blockquote")
