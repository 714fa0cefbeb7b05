"""The composed digest (`digest_flagship`) in DuckDB's SQL, down to the text of its messages."""

from __future__ import annotations

from newsloom.operators import assemble, render
from newsloom.plans.registry import oracle
from newsloom.plans.stories import _RICH, _TALLY, STORY_CTES

_LETTER = r"\pL\pN_"
_WORD = rf"[{_LETTER}]+(?:[-’''ʼ‘][{_LETTER}]+)*"
_OPENING = rf"^(?:[^{_LETTER}]*\p{{Lu}}[{_LETTER}]*(?:[-’''ʼ‘][{_LETTER}]+)*)*"


def _escaped(x: str) -> str:
    out = f"replace({x}, '&', '&amp;')"
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{char}', '{name}')"
    return out


def _label(moment: str) -> str:
    """Winter time of the digest's zone."""
    at, now = f"({moment} + INTERVAL 1 HOUR)", "(as_of + INTERVAL 1 HOUR)"
    return f"CASE WHEN CAST({now} AS DATE) = CAST({at} AS DATE) THEN strftime({at}, '%H:%M') WHEN CAST({now} AS DATE) = CAST({at} AS DATE) + 1 THEN 'yday ' || strftime({at}, '%H:%M') ELSE strftime({at}, '%d/%m %H:%M') END"


def _line(rows: str) -> str:
    """Lines as HTML. rows: words, url, at_, via, links, earlier, reply and whatever else."""
    return f"""SELECT * EXCLUDE (words, whole, start_, span, after_, at_, via, links, earlier, reply, url, opening, rest), CASE WHEN at_ IS NOT NULL THEN '<i>' || at_ || '</i>  ' ELSE '' END || {_escaped("substr(words, 1, start_)")} || '<a href="' || {_escaped("url")} || '">' || {_escaped("span")} || '</a>' || {_escaped("substr(words, start_ + length(span) + 1)")}
  || CASE WHEN via IS NOT NULL THEN ' <i>· ' || {_escaped("via")} || coalesce(', ' || links, '') || '</i>' ELSE coalesce(' <i>(' || links || ')</i>', '') END || coalesce(chr(10) || '<i>↳ to ' || reply || '</i>', '') || coalesce(chr(10) || '<i>↻ earlier: ' || earlier || '</i>', '') AS html
FROM (SELECT *, CASE WHEN whole = '' THEN string_split(words, ' ')[1] WHEN length(whole) >= 4 THEN whole || regexp_extract(after_, '^[{_LETTER}’''ʼ‘]*') ELSE regexp_extract(whole || after_, '(?s)^.{{0,4}}[{_LETTER}’''ʼ‘]*') END AS span
FROM (SELECT *, substr(words, start_ + length(whole) + 1) AS after_ FROM (
  SELECT *, CASE WHEN NOT regexp_matches(words, '[{_LETTER}]') THEN 0 WHEN regexp_matches(rest, '[{_LETTER}]') THEN length(opening) + length(regexp_extract(rest, '^[^{_LETTER}]*')) ELSE length(regexp_extract(words, '(?s)^(.*?){_WORD}[^{_LETTER}]*$', 1)) END AS start_,
    CASE WHEN NOT regexp_matches(words, '[{_LETTER}]') THEN '' WHEN regexp_matches(rest, '[{_LETTER}]') THEN regexp_extract(rest, '{_WORD}') ELSE regexp_extract(words, '(?s)^.*?({_WORD})[^{_LETTER}]*$', 1) END AS whole
  FROM (SELECT *, regexp_extract(words, '{_OPENING}') AS opening, substr(words, length(regexp_extract(words, '{_OPENING}')) + 1) AS rest FROM ({rows}))))) t0"""


_QUOTED = f"""SELECT id, array_to_string(CASE WHEN len(k) >= 6 THEN p[1:k[6]] ELSE p END, ' ') || CASE WHEN len(k) >= 6 AND k[6] < len(p) THEN '…' ELSE '' END AS quote FROM (
  SELECT id, p, list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '[{_LETTER}’''ʼ‘]')) AS k FROM (
    SELECT id, string_split_regex(regexp_replace(split_part(regexp_replace(CASE WHEN trim(summary) <> '' THEN summary ELSE raw_text END, '^\\s+|\\s+$', '', 'g'), chr(10), 1), '^\\s+|\\s+$', '', 'g'), '\\s+') AS p FROM items))"""
_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

SQL = f""", waiting AS MATERIALIZED (SELECT * REPLACE (CASE WHEN empty THEN '⚠️ ' || split_part(substr({_STRIPPED.format("raw_text")}, 1, 80), chr(10), 1) ELSE summary END AS summary)
  FROM (SELECT i.*, s.name AS source_name, s.type AS source_type, s.sort_order AS source_sort_order, s.prompt_extra, trim(summary) = '' AND trim(raw_text) <> '' AS empty, epoch(as_of - processed_at) / 86400 < 3 AS young
    FROM items i LEFT JOIN sources s ON s.id = i.source_id, present WHERE NOT sent AND coalesce(s.status, '') <> 'paused') WHERE NOT (empty AND young)),
open_ AS MATERIALIZED (SELECT *, replace(lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS t FROM waiting WHERE trim(coalesce(nullif(summary, ''), raw_text)) NOT IN ('', 'no text') AND NOT coalesce(contains(prompt_extra, 'no filter'), false)),
literal AS MATERIALIZED (SELECT * FROM (SELECT id, CASE WHEN regexp_matches(t, 'licensed\\s+under') AND category IN ('feed', 'tech') THEN '= licensed under' WHEN regexp_matches(t, 'er\\s*[-–—]+\\s*st') AND category = 'finance' AND source_id IN (5, 9) THEN '= er–st'
  WHEN regexp_matches(t, 'the') AND source_id IN (1, 6, 11) THEN '= The' END AS rule FROM open_) WHERE rule IS NOT NULL),
chunks AS MATERIALIZED (SELECT id, digest, category, source_id, (row_number() OVER (PARTITION BY digest ORDER BY category, id) - 1) // 10 AS chunk FROM open_ WHERE id NOT IN (SELECT id FROM literal)),
answers AS (SELECT digest, CASE WHEN id % 14 = 0 THEN chunk + 1 ELSE chunk END AS chunk, id, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 7 END AS word_id, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 11 END AS confidence FROM chunks),
scope AS (SELECT r.*, (SELECT list(category) FROM rule_categories c WHERE c.word_id = r.word_id) AS cats, (SELECT list(source_id) FROM rule_sources s WHERE s.word_id = r.word_id) AS srcs FROM rules r WHERE rule NOT LIKE '=%'),
asked_of AS (SELECT digest, chunk, word_id FROM (SELECT digest, chunk, list(DISTINCT category) AS c, list(DISTINCT source_id) AS s FROM chunks GROUP BY 1, 2) JOIN scope ON (cats IS NULL OR list_has_any(cats, c)) AND (srcs IS NULL OR list_has_any(srcs, s))),
judged_ AS (SELECT a.id, s.rule FROM answers a JOIN chunks c ON c.digest = a.digest AND c.chunk = a.chunk AND c.id = a.id JOIN scope s ON s.word_id = a.word_id SEMI JOIN asked_of h ON h.digest = a.digest AND h.chunk = a.chunk AND h.word_id = a.word_id
  WHERE coalesce(confidence, 10) >= 8 AND (cats IS NULL OR list_contains(cats, category)) AND (srcs IS NULL OR list_contains(srcs, source_id))),
blocked AS MATERIALIZED (SELECT b.id, b.rule, coalesce(nullif(trim(r.label), ''), b.rule) AS title FROM (SELECT * FROM literal UNION ALL SELECT * FROM judged_) b JOIN rules r USING (rule)),
cur AS MATERIALIZED (SELECT *, {_RICH} AS richness, regexp_matches(raw_text, '{_TALLY}') AS tally FROM waiting WHERE id NOT IN (SELECT id FROM blocked)),
{STORY_CTES},
shown AS MATERIALIZED (SELECT * FROM cur WHERE id NOT IN (SELECT id FROM final)),
own_emb AS (SELECT s.id, s.digest, s.source_id, CAST(v AS DOUBLE[]) AS v FROM shown s JOIN vectors USING (id)),
alike_e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM own_emb a JOIN own_emb b ON a.digest = b.digest AND a.source_id = b.source_id AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.40),
alike_both AS (SELECT a, b FROM alike_e UNION SELECT b, a FROM alike_e), alike_r(id, x) AS (SELECT a, a FROM alike_both UNION SELECT r.id, e.b FROM alike_r r JOIN alike_both e ON e.a = r.x),
member AS MATERIALIZED (SELECT s.*, coalesce(c.component, s.id) AS component, coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '') AS moment FROM shown s LEFT JOIN (SELECT id, min(x) AS component FROM alike_r GROUP BY 1) c USING (id)),
told_before AS (SELECT m.component, strftime(i.published_at, '%Y-%m-%d %H:%M:%S') AS moment, i.original_url AS url FROM updated u JOIN items i ON i.id = u.shown_id JOIN member m ON m.id = u.id WHERE i.published_at IS NOT NULL),
top AS (SELECT component, max(moment) AS top FROM member GROUP BY 1),
past AS (SELECT component, moment, url FROM told_before UNION SELECT m.component, m.moment, m.original_url FROM member m JOIN top t ON t.component = m.component AND m.moment <> t.top),
merged AS MATERIALIZED (SELECT component, list(id ORDER BY id) AS ids, arg_max(original_url, (moment, id)) AS url, max(moment) AS moment, coalesce(arg_max(summary, (moment, id)) FILTER (trim(summary) <> ''), '') AS summary, min(id) AS id FROM member GROUP BY 1),
line AS MATERIALIZED (SELECT l.*, f.digest, f.category, f.source_id, f.source_name, f.source_sort_order, f.published_at, row_number() OVER (PARTITION BY f.digest, f.category, f.source_name ORDER BY f.published_at NULLS FIRST, l.id) AS line_place,
    (SELECT string_agg('<a href="' || {_escaped("url")} || '">' || {_label("CAST(moment AS TIMESTAMP)")} || '</a>', ', ' ORDER BY moment, url) FROM past, present WHERE past.component = l.component) AS earlier FROM merged l JOIN member f ON f.id = l.id),
copied AS (SELECT m.component, s.name, arg_min(i.original_url, (s.sort_order, i.id)) AS url, min((s.sort_order, i.id)) AS k FROM final h JOIN items i ON i.id = h.id JOIN sources s ON s.id = i.source_id JOIN member m ON m.id = h.primary_id WHERE i.source_id <> m.source_id GROUP BY 1, 2),
linked AS (SELECT component, string_agg('<a href="' || {_escaped("url")} || '">' || {_escaped("name")} || '</a>', ', ' ORDER BY k) AS links FROM copied GROUP BY 1),
young_feed AS (SELECT digest, id, published_at, id % 20 // 10 AS chunk, id % 25 = 0 AS overview FROM line, present WHERE category = 'feed' AND epoch(as_of - published_at) <= 400 * 3600),
reports AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n, max(CASE WHEN overview THEN chunk END) OVER (PARTITION BY digest) AS top FROM young_feed),
led AS (SELECT *, min(CASE WHEN overview AND chunk = top THEN id END) OVER (PARTITION BY digest) AS lead FROM reports WHERE n >= 3),
folded AS (SELECT digest, id, row_number() OVER (PARTITION BY digest ORDER BY CASE WHEN id = lead THEN 0 ELSE 1 END, published_at, id) AS war FROM led),
answer AS (SELECT id, CASE WHEN (source_id + 7) % 20 % 2 = 0 THEN 'tg_src' || (id - 13) % 20 || '_' || (id - 13) ELSE md5('src' || (id - 13) % 20 || ':' || (id - 13)) END AS reply_to FROM shown WHERE id >= 13),
parent AS (SELECT a.id, p.id AS parent_id, CASE WHEN t.source_id <> p.source_id THEN t.id END AS shown_as FROM answer a JOIN items p ON p.message_id = a.reply_to LEFT JOIN final h ON h.id = p.id LEFT JOIN shown t ON t.id = h.primary_id),
quoted AS ({_QUOTED}),
replied AS (SELECT p.id, '<a href="' || {_escaped("i.original_url")} || '">' || coalesce({_label("i.published_at")}, '→') || '</a>' || coalesce(' ' || nullif({_escaped("CASE WHEN p.shown_as IS NOT NULL THEN s.name ELSE q.quote END")}, ''), '') AS reply
  FROM parent p JOIN items i ON i.id = coalesce(p.shown_as, p.parent_id) JOIN quoted q ON q.id = i.id LEFT JOIN sources s ON s.id = i.source_id, present),
place(category, emoji, place) AS (SELECT name, emoji, row_number() OVER (ORDER BY sort_order, name) FROM categories WHERE is_active),
dressed AS (SELECT l.digest, coalesce(p.place, {assemble.LAST - 1}) AS section_place, chr(10) || '<b>{render.RULE}</b>' || chr(10) || '<b>' || coalesce(p.emoji, '📌') || '  ' || array_to_string(string_split(upper(l.category), ''), ' ') || '</b>' AS section,
    CASE WHEN war IS NOT NULL THEN 0 ELSE coalesce(l.source_sort_order, {assemble.LAST}) + 1 END AS block_place, CASE WHEN war IS NOT NULL THEN '{assemble.WAR_DAY} · ' || count(war) OVER (PARTITION BY l.digest, l.category) ELSE coalesce(l.source_name, 'Unknown') END AS block,
    coalesce(war, line_place) AS line_place, l.ids, {_STRIPPED.format("l.summary")} AS words, l.url, CASE WHEN l.moment <> '' THEN {_label("CAST(l.moment AS TIMESTAMP)")} END AS at_, CASE WHEN war IS NOT NULL THEN coalesce(l.source_name, 'Unknown') END AS via, links, earlier, reply
  FROM line l LEFT JOIN linked k USING (component) LEFT JOIN place p ON p.category = l.category LEFT JOIN folded f ON f.id = l.id LEFT JOIN replied r ON r.id = l.id, present WHERE l.line_place <= 50),
gone AS MATERIALIZED (SELECT w.digest, w.id, w.summary, w.original_url, w.published_at, b.title, b.rule LIKE '=%' AS literal, CASE WHEN b.rule LIKE '=%' THEN '{assemble.LITERAL}' ELSE b.rule END AS key, count(*) OVER (PARTITION BY w.digest, CASE WHEN b.rule LIKE '=%' THEN '{assemble.LITERAL}' ELSE b.rule END) AS n FROM blocked b JOIN waiting w USING (id)),
listed AS (SELECT digest, {assemble.LAST} AS section_place, chr(10) || '{assemble.FILTERED[1:]}' AS section, 0 AS block_place, title || ' · ' || n AS block, row_number() OVER (PARTITION BY digest, key ORDER BY id) AS line_place, CAST([] AS BIGINT[]) AS ids, {_STRIPPED.format("summary")} AS words, original_url AS url, {_label("published_at")} AS at_,
    CAST(NULL AS VARCHAR) AS via, CAST(NULL AS VARCHAR) AS links, CAST(NULL AS VARCHAR) AS earlier, CAST(NULL AS VARCHAR) AS reply FROM gone, present WHERE NOT literal),
html AS MATERIALIZED (SELECT digest, section_place, section, block_place, block, line_place, ids, html FROM ({_line("SELECT * FROM dressed UNION ALL SELECT * FROM listed")})
  UNION ALL SELECT DISTINCT digest, {assemble.LAST}, chr(10) || '{assemble.FILTERED[1:]}', 1, '{assemble.LITERAL} · ' || n, 1, CAST([] AS BIGINT[]), '' FROM gone WHERE literal),
-- greedy filling: a quote's lines, then a message's units
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY digest, section_place, section, block_place, block ORDER BY line_place) AS n, {render.BLOCK_LIMIT} - length('<blockquote expandable><b>' || {_escaped("block")} || '</b>' || chr(10) || '</blockquote>') AS room FROM html),
quote_(digest, section_place, section, block_place, block, n, part, used) AS (SELECT digest, section_place, section, block_place, block, n, 0, length(html) FROM numbered WHERE n = 1
  UNION ALL SELECT b.digest, b.section_place, b.section, b.block_place, b.block, b.n, CASE WHEN q.used + 1 + length(b.html) > b.room THEN part + 1 ELSE part END, CASE WHEN q.used + 1 + length(b.html) > b.room THEN length(b.html) ELSE q.used + 1 + length(b.html) END
  FROM quote_ q JOIN numbered b ON b.digest = q.digest AND b.section_place = q.section_place AND b.section = q.section AND b.block_place = q.block_place AND b.block = q.block AND b.n = q.n + 1),
quotes AS (SELECT b.digest, b.section_place, b.section, b.block_place, b.block, q.part, flatten(list(b.ids ORDER BY b.n)) AS ids, max(length(b.html)) AS longest, '<blockquote expandable><b>' || {_escaped("b.block")} || '</b>' || chr(10) || string_agg(b.html, chr(10) ORDER BY b.n) || '</blockquote>' AS text, '<blockquote><b>' || {_escaped("b.block")} || '</b></blockquote>' AS bare
  FROM numbered b JOIN quote_ q ON b.digest = q.digest AND b.section_place = q.section_place AND b.section = q.section AND b.block_place = q.block_place AND b.block = q.block AND b.n = q.n GROUP BY b.digest, b.section_place, b.section, b.block_place, b.block, q.part),
placed AS (SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY digest, section_place, section ORDER BY block_place, block, part) = 1 AS opens FROM quotes WINDOW w AS (PARTITION BY digest ORDER BY section_place, section, block_place, block, part)),
unit AS MATERIALIZED (SELECT digest, n, ids, opens, CASE WHEN opens THEN substr(section, 2) || chr(10) ELSE '' END || CASE WHEN longest > 0 THEN text ELSE bare END AS text FROM placed),
head AS (SELECT digest, dayofyear(min(processed_at)) AS issue, count(*) AS items, '<i>#' || dayofyear(min(processed_at)) || '</i>  <b>Digest</b>  <b>18:30</b>' || chr(10) || '<i>' || strftime(min(processed_at), '%d %B') || '</i>' AS title FROM cur GROUP BY 1),
framed AS MATERIALIZED (SELECT *, '<i>end #' || issue || ' · ' || items || CASE WHEN items = 1 THEN ' item</i>' ELSE ' items</i>' END AS footer FROM head),
packed(digest, n, seq, used) AS (SELECT digest, n, 1, length(text) FROM unit WHERE n = 1
  UNION ALL SELECT u.digest, u.n, CASE WHEN over THEN p.seq + 1 ELSE p.seq END, CASE WHEN over THEN length(u.text) ELSE p.used + length(u.text) + CASE WHEN u.opens THEN 2 ELSE 1 END END
  FROM (SELECT p.*, p.used + length(u.text) + CASE WHEN u.opens THEN 2 ELSE 1 END > {render.MESSAGE_LIMIT} - greatest(length(f.title), length('<i>#' || issue || ' · {render.MANY}/{render.MANY}</i>')) - 4 - length(footer) AS over FROM packed p JOIN unit u ON u.digest = p.digest AND u.n = p.n + 1 JOIN framed f ON f.digest = p.digest) p JOIN unit u ON u.digest = p.digest AND u.n = p.n + 1),
message AS (SELECT digest, seq, string_agg(CASE WHEN opens AND n > first_n THEN chr(10) ELSE '' END || text, chr(10) ORDER BY n) AS body, flatten(list(ids ORDER BY n)) AS ids FROM (SELECT u.*, p.seq, min(u.n) OVER (PARTITION BY u.digest, p.seq) AS first_n FROM unit u JOIN packed p ON p.digest = u.digest AND p.n = u.n) GROUP BY 1, 2)
SELECT m.digest, CAST(m.seq AS BIGINT) AS seq, CASE WHEN m.seq = 1 THEN title ELSE '<i>#' || issue || ' · ' || m.seq || '/' || total || '</i>' END || chr(10) || chr(10) || body || CASE WHEN m.seq = total THEN chr(10) || chr(10) || footer ELSE '' END AS text, array_to_string(ids, ',') AS item_ids
FROM message m JOIN framed f USING (digest) JOIN (SELECT digest, max(seq) AS total FROM message GROUP BY 1) USING (digest)"""

oracle("digest_flagship", SQL)
