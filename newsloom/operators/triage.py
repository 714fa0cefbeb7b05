"""What goes to a model, what is shown as written, and what a channel didn't sign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.graph import cut

TRIVIAL, FEW_LETTERS = 80, 80


def few_own_words(raw: Column) -> Column:
    """Whether a post says so little itself that its picture is worth reading."""
    own = text.without_media_prefix(text.without_context(text.without_image_note(raw)))
    return text.letters(own) < FEW_LETTERS


def shown_as_written(raw: Column, prompt: Column, reads: Column) -> Column:
    """Short, in the reader's language or not to be translated, and not the notes of a picture."""
    body = text.without_media_prefix(text.without_context(raw))
    noted = F.coalesce(raw, F.lit("")).rlike(r"^(\[Context: [^\n]*\]\n)?(\[Forwarded from [^\]\n]*\] )?\[Image: [^\n]*\]\n")
    return (F.length(body) < TRIVIAL) & ~noted & (reads | text.wants(prompt, text.NO_TRANSLATE))


def unsigned(posts: DataFrame, footers: DataFrame) -> DataFrame:
    """Posts their channel did not sign, though it has a signature. posts: source_id, raw_text; footers: source_id, line.

    A last line is looked up by its own ending, not held against all signatures of its channel: a signature of n
    characters by its last 2 ** floor(log2 n), one join for each such length that there is (31 at most).
    """
    signs = footers.select("source_id", text.strip(text.clean_invisible(F.col("line"))).alias("_sign")).filter("_sign <> ''").distinct()
    signs = cut(signs.withColumn("_tail", F.expr("shiftleft(1, length(bin(length(_sign))) - 1)")))
    raw = text.strip(text.without_image_note(F.col("raw_text")))
    rows = posts.join(signs.select("source_id").distinct(), "source_id", "left_semi").withColumn("_raw", raw)
    open_ = (F.col("_raw") != "") & ~F.col("_raw").startswith("[Forwarded from") & ~text.is_media_only(F.col("_raw"))
    rows = rows.filter(open_).withColumn("_last", F.element_at(F.concat(F.array(F.lit("")), text.text_lines(text.clean_invisible(F.col("_raw")))), -1)).drop("_raw")
    for n in sorted(r._tail for r in signs.select("_tail").distinct().collect()):
        mine = signs.filter(F.col("_tail") == n).select(F.col("source_id").alias("_source"), F.right("_sign", F.lit(n)).alias("_end"), "_sign")
        rows = rows.join(mine, (F.col("source_id") == F.col("_source")) & (F.right("_last", F.lit(n)) == F.col("_end")) & F.endswith("_last", F.col("_sign")), "left_anti")
    return rows.drop("_last")


#: Confidence from which on an answer blocks.
AD_AT = 8


def own_adverts(posts: DataFrame, footers: DataFrame, answers: DataFrame) -> DataFrame:
    """Id of the paid posts among what sources that want no filter write themselves and don't sign.

    posts: id, source_id, raw_text, summary, prompt; answers: id, confidence (null: 10) of a provider that was
    asked about the one rule for adverts. What it wasn't asked about, or doesn't answer, stays.
    """
    asked = unsigned(posts.filter(text.wants(F.col("prompt"), text.NO_FILTER) & ~text.is_media_only(F.col("summary"))), footers)
    sure = answers.filter(F.coalesce("confidence", F.lit(10)) >= AD_AT).select("id").distinct()
    return asked.select("id").join(sure, "id", "left_semi")


def too_young(sources: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Never posted, but not here long enough for that to mean anything. sources: last_item_at, created_at."""
    young = F.col("created_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return sources.withColumn("too_young", F.col("last_item_at").isNull() & F.coalesce(young, F.lit(False)))


def throttle_streaks(answers: DataFrame, least: int = 6, span: int = 900, stale: int = 3600, longest: int = 7200) -> DataFrame:
    """Models that look withdrawn. answers: tag, moment, seq, throttled.

    A streak breaks at an answer or after a silence; one that grows too long starts anew. The latter
    depends on where it started, so a model's answers are folded in order.
    """
    from newsloom.operators.fold import folded

    def step(state: tuple | None, row: dict) -> tuple:
        count, first, last, dead = state or (0, 0.0, 0.0, None)
        at = row["at"]
        if not row["throttled"]:
            return (0, first, last, dead), None
        if not count or at - last > stale or at - first > longest:
            count, first = 0, at
        if dead is None and count + 1 >= least and at - first >= span:
            dead = at
        return (count + 1, first, at, dead), None

    rows = answers.select("tag", (F.unix_micros("moment") / 1e6).alias("at"), "seq", "throttled")
    out = folded(rows, "tag", ["at", "seq"], step, "tag string, dead double, count long", lambda tag, s: {"tag": tag, "dead": s[3], "count": s[0]})
    return out.select("tag", F.timestamp_seconds("dead").alias("dead_at"), "count")


def filtered_sections(blocked: DataFrame, rules: DataFrame) -> DataFrame:
    """One block of each judged rule, one count for all literal ones. blocked: digest, id, rule."""
    literal = F.ltrim(F.col("rule")).startswith("=")
    key = F.when(literal, "= exact phrases").otherwise(F.coalesce("rule", F.lit("?")))
    label = F.when(~literal, F.nullif(F.trim(F.coalesce("label", F.lit(""))), F.lit("")))
    rows = blocked.join(rules.select("rule", "label"), "rule", "left").withColumn("section", key).withColumn("title", label)
    return rows.groupBy("digest", "section").agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("n"))


def paged(rows: DataFrame, order: list[Column], size: int, by: str) -> DataFrame:
    """The page a row is on."""
    return rows.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))


def fires_at(with_times: DataFrame, wanted: Column) -> DataFrame:
    """Whether a category has all of the wanted minutes. with_times: digest_time."""
    from newsloom.functions.clock import parse_times

    return with_times.withColumn("fires", F.size(F.array_except(parse_times(wanted), parse_times(F.col("digest_time")))) == 0)


def rule_choices(sources: DataFrame, rule_sources: DataFrame, word_id: int) -> DataFrame:
    """Sources offered for a rule: the active ones and those it already has, in order."""
    chosen = rule_sources.filter(F.col("word_id") == word_id).select(F.col("source_id").alias("id"), F.lit(True).alias("chosen"))
    rows = sources.join(chosen, "id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))).filter("chosen OR status = 'active'")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.lower("name"), "id")))


def latest_settings(writes: DataFrame) -> DataFrame:
    """The last value written to each key. writes: key, value, seq."""
    return writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def with_attempts(items: DataFrame, failures: DataFrame, most: int = 12) -> DataFrame:
    """Attempts go up for each failed pass; a post out of attempts shows its first line. failures: id."""
    n = failures.groupBy("id").agg(F.count(F.lit(1)).alias("failed"))
    rows = items.join(n, "id", "left").withColumn("classify_attempts", F.col("classify_attempts") + F.coalesce("failed", F.lit(0)).cast("int"))
    first = F.substring(F.split_part(text.strip(F.col("raw_text")), F.lit("\n"), F.lit(1)), 1, 80)
    spent = (F.col("classify_attempts") >= most) & (F.trim(F.coalesce("summary", F.lit(""))) == "")
    return rows.withColumn("summary", F.when(spent, F.concat(F.lit("⚠️ "), first)).otherwise(F.col("summary"))).drop("failed")


def summary_pass(waiting: DataFrame, written: Column, answers: DataFrame, limit: int = 6, most: int = 12) -> DataFrame:
    """What a pass does to the posts that need a summary: id, how, summary, key_phrase, classify_attempts.

    waiting: the queue; written: whether a post is shown as it stands; answers: id, summary, key_phrase of the
    provider, asked about `limit` posts in the queue's order. Without an answer attempts go up, and a post out
    of them shows its first line.
    """
    from newsloom.operators.queue import needs_summary, queue_order

    rows = needs_summary(waiting).withColumn("written", written)
    asked = rows.filter("NOT written").orderBy(*queue_order()).limit(limit).select("id", F.lit(True).alias("asked"))
    rows = rows.join(asked, "id", "left").join(answers.select("id", F.col("summary").alias("said"), F.col("key_phrase").alias("phrase")), "id", "left")
    good = F.coalesce("asked", F.lit(False)) & (F.trim(F.coalesce("said", F.lit(""))) != "")
    failed = F.coalesce("asked", F.lit(False)) & ~good
    attempts = F.col("classify_attempts") + F.when(failed, 1).otherwise(0)
    how = F.when(F.col("written"), "written").when(good, "summarised").when(failed & (attempts >= most), "gave up").when(failed, "failed").otherwise("waits")
    own = text.without_context(text.strip(F.col("raw_text")))
    first = F.concat(F.lit("⚠️ "), F.substring(F.split_part(text.strip(F.col("raw_text")), F.lit("\n"), F.lit(1)), 1, 80))
    told = F.when(F.col("written"), own).when(good, F.col("said")).when(how == "gave up", first)
    return rows.select("id", how.alias("how"), told.alias("summary"), F.when(good, F.col("phrase")).alias("key_phrase"), attempts.cast("int").alias("classify_attempts"))


def kept_rewrites(answers: DataFrame, year: int) -> DataFrame:
    """A summary that brings in facts is written again, and the rewrite kept if it brings in strictly fewer.

    answers: id, source, summary, rewrite (null if there was none).
    """
    from newsloom.functions.facts import unsupported_column

    n = lambda c: F.size(unsupported_column(F.col(c), F.col("source"), year))
    rows = answers.withColumn("brought", n("summary")).withColumn("left", F.when(F.trim(F.coalesce("rewrite", F.lit(""))) != "", n("rewrite")))
    better = (F.col("brought") > 0) & F.coalesce(F.col("left") < F.col("brought"), F.lit(False))
    return rows.select("id", F.when(better, F.col("rewrite")).otherwise(F.col("summary")).alias("summary"), better.alias("rewritten"))


def within_budget(todo: DataFrame, seconds: DataFrame, budget: float = 120.0, size: int = 25) -> DataFrame:
    """Chunks of a digest's posts that a pass before it gets to: a chunk is begun while the time its digest's
    earlier ones took is within the budget. todo: digest, id; seconds: digest, chunk, seconds."""
    place = F.row_number().over(Window.partitionBy("digest").orderBy("id")) - 1
    rows = todo.withColumn("chunk", F.floor(place / size))
    w = Window.partitionBy("digest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spent = seconds.withColumn("spent", F.coalesce(F.sum("seconds").over(w), F.lit(0.0)))
    return rows.join(spent.select("digest", "chunk", "spent"), ["digest", "chunk"], "left").withColumn("asked", F.coalesce("spent", F.lit(0.0)) <= budget)


#: Pictures read in one cycle, seconds that they may take before another is begun, and bytes of one.
PICTURES, PICTURE_SECONDS, PICTURE_BYTES = 12, 90.0, 5 * 1024 * 1024


def pictures_read(pictures: DataFrame, most: int = PICTURES, budget: float = PICTURE_SECONDS, largest: int = PICTURE_BYTES) -> DataFrame:
    """ST11: pictures with `read`: whether their cycle gets to them. Posts past the budget stay as they are.

    pictures: cycle, seq, size (bytes, null if unknown), seconds that reading takes. Too large ones cost nothing.
    """
    fits = F.coalesce(F.col("size") <= largest, F.lit(True))
    before = Window.partitionBy("cycle").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.when(fits, 1).otherwise(0)).over(before), F.lit(0))
    spent = F.coalesce(F.sum(F.when(fits, F.col("seconds")).otherwise(0.0)).over(before), F.lit(0.0))
    return pictures.withColumn("read", fits & (taken < most) & (spent <= budget))
