"""The SQL each query is checked against, written for another engine and independent of the operators' code.

Queries without SQL are checked against brute force in the tests: those on the compatibility normal form, which the other
engine has no function for.
"""

from __future__ import annotations

#: Lines once each.
_L = """l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, line_number ORDER BY line_id) AS rn
 FROM search_lines WHERE document_id IS NOT NULL AND line_number IS NOT NULL) WHERE rn = 1)"""
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _plain(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g')))"


def _score(start: str, bonus: str = "0") -> str:
    return f"greatest(0, least(1000, 1000 - least(200, {start} * 5) + {bonus}))"


#: Hits of the word with place and score.
_H = f"""f AS (SELECT *, {_plain('text')} AS form FROM l),
h AS (SELECT document_id, line_number, line_type, text, instr(form, 'reactor') - 1 AS start,
 {_score("(instr(form, 'reactor') - 1)", "CASE WHEN line_type = 'dialogue' THEN 50 ELSE 0 END")} AS score FROM f WHERE instr(form, 'reactor') > 0)"""


def _passages(source: str, low: str = "line_number", high: str = "line_number") -> str:
    return f"""g AS (SELECT *, {low} AS lo, {high} AS hi, max({high}) OVER (PARTITION BY document_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}),
c AS (SELECT *, sum(CASE WHEN lo - far <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS cid FROM g),
p AS (SELECT document_id, cid, arg_min(lo, line_number) AS first, max(hi) AS last, count(*) AS hits, max(score) AS score FROM c GROUP BY document_id, cid),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, first) AS rank, count(*) OVER (PARTITION BY document_id) AS n FROM p),
best AS (SELECT document_id, first, last, hits, score, rank, CASE WHEN n > 3 THEN 1 ELSE 0 END AS cut FROM r WHERE rank <= 3)"""


_BEST = "SELECT document_id, first::BIGINT AS first, last::BIGINT AS last, hits::BIGINT AS hits, score::BIGINT AS score, rank::BIGINT AS rank, cut::BIGINT AS cut FROM best"
_CONTEXT = """t AS (SELECT h.document_id, h.line_number, h.score, k.term, min(f.line_number) AS line FROM h
 CROSS JOIN (VALUES ('storm'), ('lamps')) k(term) JOIN f ON f.document_id = h.document_id AND abs(f.line_number - h.line_number) <= 3 AND contains(f.form, k.term)
 GROUP BY ALL),
x AS (SELECT document_id, line_number, score, list_sort(list_distinct(list(line))) AS lines, count(*) AS n FROM t GROUP BY ALL HAVING count(*) = 2)"""
_SHOWN = """shown AS (SELECT b.document_id, b.rank, l.line_number, CASE WHEN h.line_number IS NOT NULL THEN 'match' ELSE 'context' END AS role, l.text
 FROM best b JOIN l ON l.document_id = b.document_id AND l.line_number BETWEEN greatest(1, b.first - 1) AND b.last + 1
 LEFT JOIN h ON h.document_id = l.document_id AND h.line_number = l.line_number)"""
_TAGS = "'概述','生平','相关活动','概要','overview','notes'"
_DL = r"""dl AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS line_number, unnest(s) AS text FROM
 (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS s FROM documents WHERE text IS NOT NULL))"""
_SECTIONS = rf"""tg AS (SELECT doc_id, line_number, CASE WHEN regexp_matches(trim(text), '^<[^/<>][^<>]*>$') AND trim(text, '<> ') IN ({_TAGS}) THEN trim(text, '<> ') END AS o,
 CASE WHEN regexp_matches(trim(text), '^</[^<>]+>$') THEN 1 END AS c FROM dl),
tl AS (SELECT doc_id, line_number, o, lead(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) AS nxt FROM tg WHERE o IS NOT NULL OR c IS NOT NULL),
sec AS (SELECT tl.doc_id, o AS name, line_number + 1 AS start, coalesce(nxt - 1, m.last) AS stop FROM tl JOIN (SELECT doc_id, max(line_number) AS last FROM dl GROUP BY doc_id) m USING (doc_id) WHERE o IS NOT NULL),
sections AS (SELECT * FROM sec WHERE start <= stop)"""
_NATURAL = r"list_aggregate(list_transform(regexp_extract_all(lower(document_id), '(\d+|\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN '0' || lpad(x, greatest(length(x), 20)::INT, '0') ELSE '1' || x END), 'string_agg', chr(1))"
_STREAM = f"""st AS (SELECT activity_id, document_id, line_count, row_number() OVER w - 1 AS ordinal, coalesce(sum(line_count) OVER (PARTITION BY activity_id ORDER BY sequence_index NULLS FIRST, nk, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT *, {_NATURAL} AS nk FROM search_records WHERE activity_id IS NOT NULL) WINDOW w AS (PARTITION BY activity_id ORDER BY sequence_index NULLS FIRST, nk, document_id)),
pos AS (SELECT activity_id, document_id, ordinal, before + 1 AS first, before + coalesce(line_count, 0) AS last FROM st)"""
_DICT = """dict AS (SELECT text_id, lang, text_offset, min(row_id) AS row_id, arg_min(text, row_id) AS text FROM
 (SELECT text_id, CASE upper(trim(lang)) WHEN 'ZH' THEN 'CN' ELSE upper(trim(lang)) END AS lang, text_offset, row_id, text FROM i18n WHERE text IS NOT NULL AND lang IS NOT NULL AND text_id IS NOT NULL AND text_offset IS NOT NULL) GROUP BY ALL)"""
_INTERVALS = "iv AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS start, CAST(json_extract_string(props, '$.k') AS INT) + CAST(event_id % 10 AS INT) AS stop FROM events)"


def _merged(source: str, keys: str = "user_id", name: str = "m") -> str:
    return f"""{name}1 AS (SELECT *, max(stop) OVER (PARTITION BY {keys} ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}),
{name}2 AS (SELECT *, sum(CASE WHEN start <= far + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM {name}1),
{name} AS (SELECT {keys}, min(start) AS start, max(stop) AS stop FROM {name}2 GROUP BY {keys}, isl)"""


_SESSIONS = """s1 AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) <= 21600000000 THEN 0 ELSE 1 END AS brk FROM events),
s2 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s1)"""
_TIMESTAMP = "rtrim(rtrim(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
_TYPE_CASE = "CASE WHEN document_type = 'story' THEN CASE WHEN document_category = 'memory' THEN 'operator_record' ELSE 'story' END WHEN document_type = 'character' THEN 'character_profile' WHEN document_type = 'knowledge' AND document_kind = 'wiki' THEN 'character_wiki' WHEN document_type = 'entity' THEN 'entity_profile' ELSE 'reference' END"
_LABEL = """lab AS (SELECT event_id, CASE event_id % 5
 WHEN 0 THEN (user_id % 200 + 1000) || '年 ' || month(ts) || '月 ' || day(ts) || '日 ' || hour(ts) || ':' || lpad(minute(ts)::VARCHAR, 2, '0')
 WHEN 1 THEN ((user_id % 200 + 1000) // 100) || '世纪 ' || (user_id % 10 * 10) || '年代' WHEN 2 THEN ((user_id % 200 + 1000) // 100) || '世纪'
 WHEN 3 THEN (user_id % 200 + 1000) || ' 年秋 清晨' ELSE '年代不详' END AS label, user_id, ts FROM events),
v AS (SELECT event_id, label, ts, event_id % 5 AS k, user_id % 200 + 1000 AS y, (user_id % 200 + 1000) // 100 AS c, user_id % 10 * 10 AS dec FROM lab),
b AS (SELECT *, CASE k WHEN 0 THEN y WHEN 1 THEN (c - 1) * 100 + dec WHEN 2 THEN (c - 1) * 100 + 1 WHEN 3 THEN y END AS s,
 CASE k WHEN 0 THEN y WHEN 1 THEN (c - 1) * 100 + dec + 9 WHEN 2 THEN c * 100 WHEN 3 THEN y END AS e FROM v)"""

def _read(source: str, keys: str, value: str, out: str, times: int = 3) -> str:
    """CTEs that replace ``value`` by what it holds: a string of JSON is read, up to ``times`` times."""
    parts, last = [], f"(SELECT {keys}, {value} AS j FROM {source})"
    for k in range(times):
        name = f"{out}{k}" if k + 1 < times else out
        parts.append(f"{name} AS (SELECT {keys}, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$')::JSON ELSE j END AS j FROM {last})")
        last = name
    return ",\n".join(parts)


def _level(source: str, keys: str, value: str, pos: str, out: str) -> str:
    """CTEs for the objects that ``value`` holds, with their positions: (keys, pos, j)."""
    return f"""{_read(source, keys, value, out + 'v')},
{out}l AS (SELECT {keys}, CASE json_type(j) WHEN 'OBJECT' THEN [j] WHEN 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END AS l FROM {out}v),
{out}u AS (SELECT {keys}, unnest(range(len(l))) AS {pos}, unnest(l) AS j FROM {out}l),
{_read(out + 'u', keys + ', ' + pos, 'j', out + 'w')},
{out} AS (SELECT * FROM {out}w WHERE json_type(j) = 'OBJECT')"""


def _leaf(j: str, name: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{name}') IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE json_extract_string({j}, '$.{name}') END"


#: The nested records: rows that can be read, events, sources, references.
_NESTED = f"""ok AS (SELECT row_id, activity_id, activity_name, CASE WHEN json_valid(events) THEN events::JSON END AS e FROM activity_timelines WHERE events IS NULL OR json_valid(events)),
{_level('ok', 'row_id, activity_id, activity_name', 'e', 'event_pos', 'ev')},
{_level('ev', 'row_id, activity_id, event_pos', "j->'$.sources'", 'source_pos', 'so')},
{_level('so', 'row_id, activity_id, event_pos, source_pos', "j->'$.references'", 'reference_pos', 'rf')}"""
_TIMES = f"""ex AS (SELECT *, j AS x FROM ev), {_read('ex', 'row_id, activity_id, activity_name, event_pos, x', "x->'$.time'", 'tm', 1)},
es AS (SELECT row_id, activity_id, activity_name, event_pos, {_leaf('x', 'event_id')} AS event_id, {_leaf('x', 'event')} AS event, {_leaf('j', 'text')} AS time_text, {_leaf('j', 'section')} AS time_section,
 TRY_CAST({_leaf('j', 'year_start')} AS INT) AS ys, TRY_CAST({_leaf('j', 'year_end')} AS INT) AS ye FROM tm),
lb AS (SELECT *, coalesce(nullif(time_text, ''), time_section, '') AS label FROM es),
yr AS (SELECT *, TRY_CAST(nullif(regexp_extract(label, '(\\d+)\\s*世纪', 1), '') AS INT) AS century, TRY_CAST(nullif(regexp_extract(label, '\\d\\s*世纪\\s*(\\d+)\\s*年代', 1), '') AS INT) AS decade,
 coalesce(ys, TRY_CAST(nullif(regexp_extract(label, '(^|[^\\d])(\\d{{1,4}})\\s*年', 2), '') AS INT)) AS said FROM lb),
tl AS (SELECT *, CASE WHEN decade IS NOT NULL THEN (century - 1) * 100 + decade WHEN century IS NOT NULL THEN (century - 1) * 100 + 1 ELSE said END AS year_start,
 CASE WHEN decade IS NOT NULL THEN (century - 1) * 100 + decade + 9 WHEN century IS NOT NULL THEN century * 100 ELSE coalesce(ye, said) END AS year_end FROM yr)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_NESTED} SELECT ok.row_id, coalesce(ev.event_pos, -1)::BIGINT AS event_pos, coalesce(so.source_pos, -1)::BIGINT AS source_pos, coalesce(rf.reference_pos, -1)::BIGINT AS reference_pos
FROM ok LEFT JOIN ev ON ev.row_id = ok.row_id LEFT JOIN so ON so.row_id = ev.row_id AND so.event_pos = ev.event_pos LEFT JOIN rf ON rf.row_id = so.row_id AND rf.event_pos = so.event_pos AND rf.source_pos = so.source_pos""",
    "p1_sources": f"""WITH {_NESTED} SELECT row_id, activity_id, event_pos::BIGINT AS event_pos, source_pos::BIGINT AS source_pos, {_leaf('j', 'text')} AS text, {_leaf('j', 'story_name')} AS story_name, {_leaf('j', 'activity_name')} AS activity_name FROM so""",
    "p1_references": f"""WITH {_NESTED} SELECT row_id, activity_id, event_pos::BIGINT AS event_pos, source_pos::BIGINT AS source_pos, reference_pos::BIGINT AS reference_pos, {_leaf('j', 'document_id')} AS document_id,
 TRY_CAST({_leaf('j', 'line_start')} AS INT) AS line_start, TRY_CAST({_leaf('j', 'line_end')} AS INT) AS line_end FROM rf""",
    "p1_activities": "SELECT row_id, activity_id, activity_name, game, source, loaded_at, CASE WHEN events IS NULL THEN 'null' WHEN json_valid(events) THEN 'ok' ELSE 'invalid' END AS status FROM activity_timelines",
    "p1_events": f"""WITH {_NESTED}, ex AS (SELECT *, j AS x FROM ev), {_read('ex', 'row_id, activity_id, event_pos, x', "x->'$.time'", 'tm', 1)}, et AS (SELECT *, j AS t FROM tm), {_read('et', 'row_id, activity_id, event_pos, x, t', "x->'$.source_location'", 'lo', 1)}
SELECT row_id, activity_id, event_pos::BIGINT AS event_pos, {_leaf('x', 'event_id')} AS event_id, {_leaf('t', 'text')} AS time_text, TRY_CAST({_leaf('t', 'year_start')} AS INT) AS time_year_start, TRY_CAST({_leaf('t', 'year_end')} AS INT) AS time_year_end,
 {_leaf('t', 'section')} AS time_section, {_leaf('x', 'event')} AS event, {_leaf('j', 'document_id')} AS source_location_document_id, TRY_CAST({_leaf('j', 'line')} AS INT) AS source_location_line FROM lo""",
    "timeline_provenance": f"WITH {_NESTED}, {_TIMES} SELECT event_id, count(DISTINCT row_id) AS rows FROM tl WHERE regexp_matches(event_id, '^tle_[0-9a-f]{{24}}$') GROUP BY event_id",
    "timeline_year_overlap": f"WITH {_NESTED}, {_TIMES} SELECT row_id, event_pos::BIGINT AS event_pos, event_id, year_start, year_end FROM tl WHERE year_end >= 1030 AND year_start <= 1050",
    "timeline_activity_infer": f"WITH {_NESTED}, {_TIMES} SELECT row_id, event_pos::BIGINT AS event_pos, event_id, activity_name FROM tl WHERE activity_name = '白石渡口 RE-4'",
    "timeline_words": f"""WITH {_NESTED}, {_TIMES}, st AS (SELECT row_id, event_pos, string_agg({_leaf('j', 'text')}, chr(10) ORDER BY source_pos) AS texts FROM so GROUP BY ALL),
hy AS (SELECT tl.row_id, tl.event_pos, event, lower(concat_ws(chr(10), event, time_text, texts)) AS hay FROM tl LEFT JOIN st ON st.row_id = tl.row_id AND st.event_pos = tl.event_pos)
SELECT row_id, event_pos::BIGINT AS event_pos, event FROM hy WHERE contains(hay, '反应堆') AND (contains(hay, '波') OR contains(hay, '莫'))""",
    "stream_sessions": f"""WITH {_SESSIONS} SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS entries FROM s2 GROUP BY user_id, session""",
    "natural_title": r"""WITH t AS (SELECT document_id, game, document_category, sequence_index, story_code, regexp_replace(trim(display_title), '\s+', ' ', 'g') AS dt,
 list_distinct(list_filter([trim(regexp_replace(activity_name, '\s+', ' ', 'g')), trim(regexp_replace(story_code, '\s+', ' ', 'g'))], lambda x: x IS NOT NULL AND x != '')) AS ids, trim(regexp_replace(activity_name, '\s+', ' ', 'g')) AS an, trim(regexp_replace(story_code, '\s+', ' ', 'g')) AS sc,
 CASE WHEN lower(trim(part_type)) IN ('before', 'after') THEN lower(trim(part_type)) WHEN lower(trim(part_type)) IN ('story', 'interlude', 'body') THEN 'story' END AS part FROM search_records),
b AS (SELECT document_id, game, CASE WHEN coalesce(an, '') = '' AND coalesce(sc, '') = '' THEN coalesce(dt, '') ELSE concat_ws(' · ', nullif(an, ''), CASE WHEN sc IS DISTINCT FROM an THEN nullif(sc, '') END, part,
 CASE WHEN document_category = 'activity' AND coalesce(story_code, '') = '' AND sequence_index IS NOT NULL THEN '第 ' || sequence_index || ' 篇' END) END AS base FROM t)
SELECT document_id, CASE WHEN base = '' THEN '' ELSE CASE game WHEN 'game_b' THEN 'B' ELSE 'A' END || ' · ' || base END AS title FROM b""",
    "i18n_page_fold": f"""WITH RECURSIVE {_DICT}, w AS (SELECT text_id, length(string_agg(text, ' ' ORDER BY text_offset, row_id)) AS n FROM dict WHERE lang = 'CN' GROUP BY text_id),
o AS (SELECT text_id, n, row_number() OVER (ORDER BY text_id) AS k FROM w QUALIFY k <= 20),
f AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS text_id, 0::BIGINT AS shown, 4000::BIGINT AS "left", false AS stopped
 UNION ALL SELECT o.k, o.text_id, least(f."left" // 2, o.n), f."left" - least(f."left" // 2, o.n), o.n > f."left" // 2 FROM f JOIN o ON o.k = f.k + 1 WHERE NOT f.stopped AND f."left" >= 100)
SELECT k AS ord, text_id, shown FROM f WHERE k > 0""",
    "search_literal_passages": f"WITH {_L}, {_H}, {_passages('h')} {_BEST}",
    "search_regex_lines": f"""WITH {_L}, m AS (SELECT document_id, line_number, text, regexp_extract(text, '[0-9]{{4}} lamps') AS x FROM l)
SELECT document_id, line_number::BIGINT AS line_number, (instr(text, x) - 1)::BIGINT AS start, length(x)::BIGINT AS length FROM m WHERE x != ''""",
    "search_speaker_filter": f"""WITH {_L} SELECT document_id, line_number::BIGINT AS line_number,
 CASE WHEN line_type = 'dialogue' AND starts_with(text, 'Moxorjo:') THEN ltrim(substr(text, 9)) ELSE text END AS content FROM l WHERE speaker_raw = 'Moxorjo'""",
    "search_metadata_filter": """SELECT document_id, activity_name FROM search_records
WHERE lower(trim(game)) = 'game_a' AND lower(trim(part_type)) = 'before' AND (contains(activity_name, '守夜人') OR (activity_name != '' AND contains('守夜人', activity_name)))""",
    "search_resource_tags": """SELECT document_id, unnest(CASE WHEN document_type = 'story' AND document_category = 'memory' THEN ['character_bundle', 'character_story', 'operator_record']
 WHEN document_type = 'story' AND (document_kind IS NULL OR document_kind != 'synopsis') THEN ['original_story', 'story'] ELSE [] END) AS tag FROM search_records""",
    "search_title_hits": """SELECT document_id, CASE WHEN lower(display_title) = 'kx-1' OR lower(story_code) = 'kx-1' THEN 1 ELSE 0 END::BIGINT AS exact
FROM search_records WHERE contains(lower(concat_ws(chr(10), display_title, activity_name, story_code)), 'kx-1')""",
    "search_context_terms": f"""WITH {_L}, {_H}, {_CONTEXT} SELECT document_id, line_number::BIGINT AS line_number, array_to_string(lines, ',') AS term_lines FROM x""",
    "search_context_passages": f"""WITH {_L}, {_H}, {_CONTEXT}, y AS (SELECT *, least(line_number, lines[1]) AS low, greatest(line_number, lines[-1]) AS high FROM x),
{_passages('y', 'low', 'high')} {_BEST}""",
    "search_entity_mention": f"""WITH {_L}, lt AS (SELECT document_id, line_number, concat_ws(': ', speaker_raw, text) AS text, entity_occurrences FROM l),
o AS (SELECT document_id, line_number, text, instr(text, 'the') - 1 AS s, unnest(entity_occurrences) AS occ FROM lt WHERE instr(text, 'the') > 0),
p AS (SELECT *, occ.entity_id AS entity_id, occ.raw_name AS raw_name FROM o),
q AS (SELECT document_id, line_number, entity_id, raw_name, s, unnest(range(0, length(text) - length(raw_name) + 1)) AS i, text FROM p WHERE length(raw_name) > 0),
z AS (SELECT document_id, line_number, entity_id, raw_name, min(greatest(0, i - (s + 3), s - (i + length(raw_name)))) AS distance FROM q WHERE substr(text, (i + 1)::BIGINT, length(raw_name)) = raw_name GROUP BY ALL)
SELECT document_id, line_number::BIGINT AS line_number, entity_id, raw_name, distance::BIGINT AS distance FROM z WHERE distance <= 256""",
    "search_match_cap24": f"""WITH {_L}, f AS (SELECT document_id, line_number, instr({_plain('text')}, 'e') - 1 AS start FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS rk FROM f WHERE start >= 0)
SELECT document_id, line_number::BIGINT AS line_number, start::BIGINT AS start FROM r WHERE rk <= 24""",
    "search_score_docs": f"WITH {_L}, {_H} SELECT document_id, max(score)::BIGINT AS score, count(*) AS lines FROM h GROUP BY document_id",
    "search_interleave_order": """WITH t AS (SELECT document_id, CASE game WHEN 'game_b' THEN 1 WHEN 'game_a' THEN 2 ELSE 3 END AS g FROM search_records),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY document_id) AS turn FROM t)
SELECT document_id, row_number() OVER (ORDER BY g = 3, turn, g) - 1 AS ordinal FROM r""",
    "search_page_anchor": f"""WITH {_L}, sz AS (SELECT document_id, sum(coalesce(length(text), 0)) AS chars FROM l GROUP BY document_id),
t AS (SELECT document_id, CASE game WHEN 'game_a' THEN 1 WHEN 'game_b' THEN 2 ELSE 3 END AS g FROM search_records),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY document_id) AS turn FROM t),
o AS (SELECT document_id, row_number() OVER (ORDER BY g = 3, turn, g) - 1 AS ordinal FROM r),
w AS (SELECT o.document_id, ordinal, row_number() OVER (ORDER BY ordinal) AS k, sum(coalesce(chars, 0)) OVER (ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS running FROM o LEFT JOIN sz USING (document_id) WHERE ordinal > 20 AND ordinal <= 276)
SELECT document_id, ordinal::BIGINT AS ordinal, running::BIGINT AS running FROM w WHERE k <= 12 AND (running <= 12000 OR k = 1)""",
    "search_excerpt_roles": f"WITH {_L}, {_H}, {_passages('h')}, {_SHOWN} SELECT document_id, rank::BIGINT AS rank, line_number::BIGINT AS line_number, role, text FROM shown",
    "search_highlight": f"WITH {_L}, {_H} SELECT document_id, line_number::BIGINT AS line_number, regexp_replace(text, '(reactor)', '【\\1】', 'gi') AS marked FROM h",
    "search_anchor_line": f"""WITH {_L}, r AS (SELECT document_id, line_number, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN line_type = 'dialogue' THEN 0 ELSE 1 END, line_number) AS k FROM l WHERE length(trim(text)) > 0)
SELECT document_id, line_number::BIGINT AS line_number FROM r WHERE k = 1""",
    "search_evidence_kind": f"""SELECT {_TYPE_CASE} AS resource_type, CASE lower(document_kind) WHEN 'story' THEN 'dialogue' WHEN 'wiki' THEN 'knowledge' WHEN 'reference' THEN 'knowledge' ELSE CASE WHEN document_type = 'story' THEN 'dialogue' ELSE 'knowledge' END END AS content_type, count(*) AS n FROM search_records GROUP BY ALL""",
    "preview_cost": f"""WITH {_L}, {_H}, {_passages('h')}, {_SHOWN}
SELECT document_id, sum(coalesce(length(text), 0))::BIGINT AS chars, CASE WHEN sum(coalesce(length(text), 0)) <= 600 THEN 1 ELSE 0 END::BIGINT AS fits FROM shown GROUP BY document_id""",
    "gram_postings": f"""WITH {_L}, g AS (SELECT document_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM l WHERE length(text) >= 3)
SELECT substr(t, i::BIGINT, 3) AS gram, count(DISTINCT document_id) AS n_docs FROM g GROUP BY 1""",
    "gram_division": f"""WITH {_L}, q AS (SELECT document_id, count(DISTINCT g.gram) AS n FROM l JOIN (VALUES ('rea'), ('eac'), ('act'), ('cto'), ('tor')) g(gram) ON contains(lower(text), g.gram) GROUP BY document_id)
SELECT document_id FROM q WHERE n = 5""",
    "gram_union_title": f"""WITH {_L}, q AS (SELECT document_id, count(DISTINCT g.gram) AS n FROM l JOIN (VALUES ('cry'), ('rys'), ('yst'), ('sta'), ('tal')) g(gram) ON contains(lower(text), g.gram) GROUP BY document_id),
c AS (SELECT document_id FROM q WHERE n = 5 UNION SELECT document_id FROM search_records WHERE contains(lower(display_title), 'kx-1'))
SELECT document_id FROM c WHERE document_id IN (SELECT document_id FROM search_records WHERE game = 'game_a')""",
    "short_literal_scan": f"WITH {_L} SELECT DISTINCT document_id FROM l WHERE contains(lower(text), 'xo')",
    "request_scope": """SELECT document_id, CASE WHEN lower(trim(game)) IN ('game_a', 'game_b') THEN lower(trim(game)) WHEN contains(lower(document_id), 'game_b:') THEN 'game_b' ELSE 'game_a' END AS game, 'operator_record' AS resource_type, 'dialogue' AS content_type
FROM search_records WHERE document_type = 'story' AND document_category = 'memory' AND lower(document_kind) IN ('story', 'synopsis')""",
    "request_candidates": f"""WITH {_L}, q AS (SELECT document_id, count(DISTINCT g.gram) AS n FROM l JOIN (VALUES ('rea'), ('eac'), ('act'), ('cto'), ('tor')) g(gram) ON contains(lower(text), g.gram) GROUP BY document_id HAVING count(DISTINCT g.gram) = 5),
c AS (SELECT document_id, CASE lower(trim(game)) WHEN 'game_a' THEN 1 ELSE 2 END AS g FROM search_records WHERE document_id IN (SELECT document_id FROM q) OR contains(lower(concat_ws(chr(10), display_title, activity_name, story_code)), 'reactor')),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY document_id) AS turn FROM c) SELECT document_id, row_number() OVER (ORDER BY turn, g) - 1 AS ordinal FROM r""",
    "request_matches": f"""WITH {_L}, f AS (SELECT document_id, line_number, line_type, text, {_plain("CASE WHEN line_type = 'dialogue' AND coalesce(speaker_raw, '') != '' AND starts_with(text, speaker_raw || ':') THEN ltrim(substr(text, length(speaker_raw) + 2)) ELSE text END")} AS form, {_plain('text')} AS whole FROM l),
h AS (SELECT document_id, line_number, instr(form, 'reactor') - 1 AS start FROM f WHERE contains(form, 'reactor')),
t AS (SELECT h.document_id, h.line_number, h.start, min(f.line_number) AS line FROM h JOIN f ON f.document_id = h.document_id AND abs(f.line_number - h.line_number) <= 3 AND contains(f.whole, 'storm') GROUP BY ALL)
SELECT document_id, line_number::BIGINT AS line_number, start::BIGINT AS start, {_score('start')}::BIGINT AS score, least(line_number, line)::BIGINT AS low, greatest(line_number, line)::BIGINT AS high FROM t WHERE document_id IN (SELECT document_id FROM search_records)""",
    "request_items": f"""WITH {_L}, y AS (SELECT document_id, line_number, 500 AS score FROM l WHERE speaker_raw = 'Moxorjo' AND document_id IN (SELECT document_id FROM search_records)), {_passages('y')}
SELECT document_id, 'speaker_raw' AS field, 'speaker' AS kind, first::BIGINT AS first, last::BIGINT AS last, hits::BIGINT AS hits, score::BIGINT AS score, rank::BIGINT AS rank FROM best""",
    "document_summary": "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("document_id", "display_title", "document_type", "document_kind", "document_category", "activity_id", "activity_name", "story_code", "part_type", "previous_document_id", "next_document_id")) + ", '' AS path FROM search_records",
    "index_lookup": f"""WITH {_L} SELECT document_id FROM l JOIN (VALUES ('cry'), ('rys'), ('yst'), ('sta'), ('tal')) g(gram) ON contains(lower(text), g.gram) GROUP BY document_id HAVING count(DISTINCT g.gram) = 5""",
    "index_postings": """WITH g AS (SELECT document_id, lower(speaker_raw) AS t, unnest(range(1, length(speaker_raw))) AS i FROM search_lines WHERE length(speaker_raw) > 1 AND document_id IS NOT NULL AND line_number IS NOT NULL)
SELECT substr(t, i::BIGINT, 2) AS gram, count(DISTINCT document_id) AS documents FROM g GROUP BY 1""",
    "index_key_ranges": """WITH g AS (SELECT document_id, lower(display_title) AS t, unnest(range(1, length(display_title) - 1)) AS i FROM search_records WHERE length(display_title) > 2)
SELECT count(DISTINCT (document_id, substr(t, i::BIGINT, 3))) AS rows, 0::BIGINT AS overlaps FROM g""",
    "timeline_marker": f"WITH {_NESTED}, {_TIMES} SELECT row_id, event_pos::BIGINT AS event_pos, event_id FROM tl WHERE event_id IN ('tle_0057923ece109afde7761193', 'tle_011f3d2f73bbbe11c173d960')",
    "timeline_shown_times": f"""WITH {_NESTED}, {_TIMES}, s AS (SELECT row_id, event_pos, ys, coalesce(ye, ys) AS ye, trim(coalesce(nullif(time_text, ''), nullif(time_section, ''), '时间不详')) AS t FROM tl),
y AS (SELECT *, CASE WHEN ye != ys THEN ys || '-' || ye ELSE ys::VARCHAR END || ' 年' AS yy FROM s)
SELECT row_id, event_pos::BIGINT AS event_pos, CASE WHEN regexp_matches(t, '年|世纪|纪元') OR ys IS NULL OR ys < 0 THEN t WHEN t = '时间不详' THEN yy ELSE yy || ' ' || t END AS shown FROM y""",
    "i18n_lookup": f"WITH {_DICT} SELECT text_id, lang, text_offset, row_id FROM dict WHERE {_plain('text')} = 'fenwensil found the dark engine inside the cold store in the ninth month.'",
    "i18n_document_texts": "WITH r AS (SELECT text_id, unnest(refs) AS r FROM i18n_catalog) SELECT text_id, r.line_start::BIGINT AS line_start, r.line_end::BIGINT AS line_end, r.field AS field FROM r WHERE r.document_id = 'official:story:th_127' AND 5 BETWEEN r.line_start AND r.line_end",
    "phrase_containment": "SELECT DISTINCT n.name_id, s.line_id FROM (SELECT name_id, name FROM canonical_names WHERE field = 'text') n JOIN search_lines s ON contains(s.text, n.name)",
    "longest_span_select": """WITH n AS (SELECT DISTINCT substr(canonical_name, 1, 2) AS alias, entity_id AS canonical FROM entities UNION SELECT canonical_name, entity_id FROM entities),
t AS (SELECT entity_id, concat_ws(chr(10), canonical_name, description, history_summary) AS text FROM entities),
p AS (SELECT t.entity_id, n.canonical, n.alias, t.text, unnest(range(0, length(t.text) - length(n.alias) + 1)) AS s FROM t JOIN n ON length(n.alias) > 1 AND contains(t.text, n.alias)),
m AS (SELECT DISTINCT entity_id, canonical, s AS start, s + length(alias) AS stop FROM p WHERE substr(text, (s + 1)::BIGINT, length(alias)) = alias)
SELECT entity_id, canonical, start::BIGINT AS start, stop::BIGINT AS stop FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.entity_id = a.entity_id AND b.start <= a.start AND b.stop >= a.stop AND (b.start, b.stop) != (a.start, a.stop))""",
    "alias_closure": """WITH e AS (SELECT canonical_name AS canonical, game, trim(unnest(list_append(coalesce(aliases, []), canonical_name))) AS alias FROM entities WHERE canonical_name != ''),
k AS (SELECT * FROM e WHERE alias != '' AND (alias = canonical OR NOT EXISTS (SELECT 1 FROM entities o WHERE o.canonical_name = e.alias AND (o.canonical_name != e.canonical OR o.game IS DISTINCT FROM e.game))))
SELECT canonical, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases, array_to_string(list_sort(list(DISTINCT game)), '|') AS games FROM k GROUP BY canonical""",
    "alias_lookup": """WITH e AS (SELECT canonical_name AS canonical, game, trim(unnest(list_append(coalesce(aliases, []), canonical_name))) AS alias FROM entities WHERE canonical_name != ''),
k AS (SELECT * FROM e WHERE alias != '' AND (alias = canonical OR NOT EXISTS (SELECT 1 FROM entities o WHERE o.canonical_name = e.alias AND (o.canonical_name != e.canonical OR o.game IS DISTINCT FROM e.game))))
SELECT alias, min(canonical) AS canonical FROM k GROUP BY alias""",
    "relation_hints": """WITH n AS (SELECT name_id, name FROM canonical_names WHERE field = 'activity_name'), r AS (SELECT a.name_id AS id, a.name AS a, b.name AS b FROM n a JOIN n b ON b.name_id = a.name_id + 1)
SELECT s.document_id, r.a, r.b FROM search_records s JOIN r ON contains(s.activity_name, r.a) OR contains(s.activity_name, r.b)""",
    "preferred_duplicate": """SELECT document_id, display_title, CASE WHEN row_number() OVER (PARTITION BY display_title ORDER BY line_count DESC, document_id) = 1 THEN 1 ELSE 0 END::BIGINT AS kept
FROM search_records WHERE display_title IS NOT NULL""",
    "normalise_text": f"SELECT doc_id, md5({_plain('text')}) AS form, length({_plain('text')})::BIGINT AS n FROM documents",
    "strip_markup": "SELECT row_id, text || chr(10) || 'end' AS bare FROM i18n",
    "stage_code": r"""WITH c AS (SELECT document_id, upper(regexp_replace(story_code, '\s+', '', 'g')) AS code, story_code, upper(regexp_replace(lower(display_title), '\s+', '', 'g')) AS relaxed FROM search_records)
SELECT document_id, CASE WHEN regexp_matches(code, '^[A-Z0-9]+(-[A-Z0-9]+)*$') AND length(code) <= 32 AND NOT regexp_matches(story_code, '\s') THEN code ELSE '' END AS code,
 CASE WHEN regexp_matches(relaxed, '^[A-Z0-9]+(-[A-Z0-9]+)*$') AND length(relaxed) <= 32 THEN relaxed ELSE '' END AS relaxed FROM c""",
    "natural_sort": f"SELECT document_id, game, row_number() OVER (PARTITION BY game ORDER BY {_NATURAL}, document_id)::BIGINT AS rank FROM search_records",
    "document_uid": """SELECT document_id, 'doc_' || substr(translate(replace(to_base64(unhex(sha256('document' || chr(0) || document_id))), '=', ''), '+/', '-_'), 1, 16) AS uid,
 CASE WHEN contains(lower(document_id), 'game_b:') THEN 'game_b' ELSE 'game_a' END AS game FROM search_records""",
    "classify_parts": """WITH c AS (SELECT document_id, lower(trim(part_type)) AS p, document_category, activity_name, sequence_index AS n FROM search_records),
d AS (SELECT *, CASE WHEN n < 10 THEN substr('零一二三四五六七八九', n + 1, 1) WHEN n <= 99 THEN CASE WHEN n >= 20 THEN substr('零一二三四五六七八九', n // 10 + 1, 1) ELSE '' END || '十' || CASE WHEN n % 10 > 0 THEN substr('零一二三四五六七八九', n % 10 + 1, 1) ELSE '' END ELSE n::VARCHAR END AS han FROM c),
e AS (SELECT *, CASE WHEN n IS NULL THEN [activity_name] ELSE [activity_name, '第' || n || '章', '第' || han || '章', n || '章', '主线' || n || '章', '主线第' || n || '章'] END AS al FROM d)
SELECT document_id, CASE WHEN p IN ('before', 'after') THEN p WHEN p IN ('story', 'interlude', 'body') THEN 'story' ELSE '' END AS part,
 CASE WHEN document_category = 'memory' THEN regexp_extract(document_id, '_([1-9][0-9]*)$', 1) ELSE '' END AS segment,
 coalesce(array_to_string(list_sort(list_distinct(list_filter(al, lambda x: x IS NOT NULL AND x != ''))), '|'), '') AS aliases FROM e""",
    "render_line": f"""WITH {_L} SELECT document_id, line_number::BIGINT AS line_number,
 'L' || line_number || ' ' || CASE WHEN length(trim(coalesce(speaker_raw, ''), ' ')) > 0 THEN trim(speaker_raw, ' ') || ': ' ELSE '' END || coalesce(text, '') AS shown, ceil(length(coalesce(text, '')) / 2.5)::BIGINT AS tokens FROM l""",
    "escape_clip": rf"""SELECT doc_id, replace(replace(replace(replace(replace(substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '{_SPACE}+', ' ', 'g')), 1, 160), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped,
 CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS clipped FROM documents WHERE text IS NOT NULL""",
    "tag_sections": f"WITH {_DL}, {_SECTIONS} SELECT doc_id, name, start::BIGINT AS start, stop::BIGINT AS stop FROM sections",
    "section_lines": f"""WITH {_DL}, {_SECTIONS}, j AS (SELECT dl.doc_id, dl.line_number, s.name, row_number() OVER (PARTITION BY dl.doc_id, dl.line_number ORDER BY s.stop - s.start, s.start, s.name) AS k
 FROM dl JOIN sections s ON s.doc_id = dl.doc_id AND dl.line_number BETWEEN s.start AND s.stop) SELECT doc_id, line_number::BIGINT AS line_number, name FROM j WHERE k = 1""",
    "joined_lines_hash": f"WITH {_L} SELECT document_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY line_number)) AS sha256 FROM l GROUP BY document_id",
    "read_around": f"""WITH {_L}, r AS (SELECT document_id, line_number, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN line_type = 'dialogue' THEN 0 ELSE 1 END, line_number) AS k FROM l WHERE length(trim(text)) > 0)
SELECT l.document_id, l.line_number::BIGINT AS line_number FROM l JOIN r ON r.k = 1 AND r.document_id = l.document_id AND l.line_number BETWEEN r.line_number - 1 AND r.line_number + 2""",
    "read_budget_prefix": f"""WITH {_L}, w AS (SELECT document_id, line_number, sum(coalesce(length(text), 0)) OVER (PARTITION BY document_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS running,
 row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS k FROM l) SELECT document_id, line_number::BIGINT AS line_number, running::BIGINT AS running FROM w WHERE k <= 10 AND running <= 600""",
    "read_stream_positions": f"WITH {_STREAM} SELECT activity_id, document_id, ordinal::BIGINT AS ordinal, first::BIGINT AS first, last::BIGINT AS last FROM pos",
    "read_stream_page": f"""WITH {_STREAM} SELECT activity_id, document_id, (greatest(11, first) - first + 1)::BIGINT AS start, (least(35, last) - first + 1)::BIGINT AS stop FROM pos WHERE last >= 11 AND first <= 35 AND last >= first""",
    "read_stream_orders": """WITH c AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, o_orderkey, o_orderdate, n FROM orders LEFT JOIN c USING (o_orderkey)),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o)
SELECT o_custkey::BIGINT AS o_custkey, o_orderkey::BIGINT AS o_orderkey, ordinal::BIGINT AS ordinal, (b + 1)::BIGINT AS first, (b + coalesce(n, 0))::BIGINT AS last FROM s""",
    "read_adjacent": """SELECT r.document_id, CASE WHEN r.previous_document_id IS NULL THEN 'none' WHEN p.document_id IS NULL THEN 'dangling' ELSE 'there' END AS previous_status,
 CASE WHEN r.next_document_id IS NULL THEN 'none' WHEN n.document_id IS NULL THEN 'dangling' ELSE 'there' END AS next_status, p.display_title AS previous_title, n.display_title AS next_title
FROM search_records r LEFT JOIN search_records p ON p.document_id = r.previous_document_id LEFT JOIN search_records n ON n.document_id = r.next_document_id""",
    "read_redirect": """WITH f AS (SELECT activity_id, story_code, min(document_id) AS t FROM search_records WHERE coalesce(document_kind, '') != 'synopsis' GROUP BY ALL)
SELECT r.document_id, CASE WHEN r.document_kind = 'synopsis' THEN coalesce(f.t, r.document_id) ELSE r.document_id END AS target FROM search_records r LEFT JOIN f ON f.activity_id = r.activity_id AND f.story_code = r.story_code""",
    "lookup_unique": "SELECT display_title AS name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(document_id) END AS document_id FROM search_records WHERE length(display_title) > 0 GROUP BY display_title",
    "ambiguous_groups": "SELECT game, story_code, count(DISTINCT activity_id) AS activities, count(*) AS documents FROM search_records WHERE length(story_code) > 0 GROUP BY ALL HAVING count(DISTINCT activity_id) > 1",
    "hydrate_filter": f"WITH {_L} SELECT document_id, count(*) AS n_lines FROM l WHERE document_id IN (SELECT document_id FROM search_records WHERE game = 'game_b' AND NOT regexp_matches(document_id, '(?i)(^|/)(tutorial(_|/)|training/)')) GROUP BY document_id",
    "pack_order": "SELECT source, count(*) AS n, CASE source WHEN 'story' THEN 0 WHEN 'record' THEN 1 WHEN 'profile' THEN 2 WHEN 'voice' THEN 3 WHEN 'wiki' THEN 4 ELSE 5 END::BIGINT AS rank FROM documents WHERE source IS NOT NULL GROUP BY source",
    "timeline_parse_time": f"""WITH {_LABEL} SELECT event_id, label, s::BIGINT AS start, e::BIGINT AS "end", coalesce(s, 9999999)::BIGINT AS year,
 CASE k WHEN 0 THEN month(ts) WHEN 3 THEN 9 WHEN 4 THEN 13 ELSE 0 END::BIGINT AS month, CASE k WHEN 0 THEN day(ts) WHEN 4 THEN 32 ELSE 0 END::BIGINT AS day,
 CASE k WHEN 0 THEN hour(ts) * 60 + minute(ts) WHEN 3 THEN 300 WHEN 4 THEN 1440 ELSE 0 END::BIGINT AS minute FROM b""",
    "timeline_merge_log": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_id, (ts, event_id)) AS first_id, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS types, count(*) AS n FROM events GROUP BY 1, 2""",
    "i18n_exact": f"WITH {_DICT} SELECT lang, {_plain('text')} AS form, count(*) AS places, count(DISTINCT text_id) AS texts FROM dict GROUP BY 1, 2",
    "i18n_literal": f"WITH {_DICT} SELECT text_id, lang, text_offset, row_id FROM dict WHERE contains(lower(text), 'the engine')",
    "i18n_missing_ids": f"""WITH {_DICT}, c AS (SELECT DISTINCT text_id, upper(trim(x)) AS lang FROM (SELECT text_id, unnest(languages) AS x FROM i18n_catalog))
SELECT text_id, lang FROM c WHERE NOT EXISTS (SELECT 1 FROM dict d WHERE d.text_id = c.text_id AND d.lang = c.lang)""",
    "i18n_align": f"""WITH {_DICT}, w AS (SELECT text_id, lang, string_agg(text, ' ' ORDER BY text_offset, row_id) AS t FROM dict GROUP BY ALL),
p AS (SELECT text_id, {", ".join(f"min(t) FILTER (lang = '{x}') AS {x}" for x in ("CN", "EN", "DE", "FR"))} FROM w GROUP BY text_id)
SELECT text_id, {", ".join(f"CASE WHEN {x} IS NULL THEN 'missing' WHEN length({x}) <= 100 THEN 'unavailable' ELSE 'available' END AS {x.lower()}_status, substr({x}, 101, 200) AS {x.lower()}_text" for x in ("CN", "EN", "DE", "FR"))} FROM p""",
    "i18n_by_line": "WITH r AS (SELECT text_id, unnest(refs) AS r FROM i18n_catalog) SELECT r.document_id AS document_id, count(DISTINCT text_id) AS texts, min(r.line_start)::BIGINT AS first, max(r.line_end)::BIGINT AS last FROM r GROUP BY 1",
    "i18n_broken_refs": """WITH r AS (SELECT text_id, unnest(refs) AS r FROM i18n_catalog), x AS (SELECT text_id, r.document_id AS document_id, r.line_start AS line_start, r.line_end AS line_end FROM r)
SELECT text_id, x.document_id, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM x LEFT JOIN search_records s ON s.document_id = x.document_id
WHERE line_count IS NULL OR line_start < 1 OR line_end < line_start OR line_end > line_count""",
    "session_reset": f"""WITH {_SESSIONS} SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS entries, {_TIMESTAMP.format('min(ts)')} AS first, {_TIMESTAMP.format('max(ts)')} AS last FROM s2 GROUP BY user_id, session""",
    "session_query_dedup": f"""SELECT user_id, event_type || ':' || props AS signature, {_TIMESTAMP.format('min(ts)')} AS first_ts, count(*) AS times FROM events GROUP BY 1, 2""",
    "coverage_merge": f"WITH {_INTERVALS}, {_merged('iv')} SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop FROM m",
    "coverage_visible": f"""WITH {_INTERVALS}, ev AS (SELECT * FROM iv WHERE event_id % 2 = 0), {_merged('ev')},
seen AS (SELECT DISTINCT user_id, unnest(range(start, stop + 1)) AS line FROM iv WHERE event_id % 2 = 1),
n AS (SELECT m.user_id, m.start, m.stop, count(s.line) AS k FROM m LEFT JOIN seen s ON s.user_id = m.user_id AND s.line BETWEEN m.start AND m.stop GROUP BY ALL)
SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop FROM n WHERE CASE WHEN stop - start + 1 <= 8 THEN k = stop - start + 1 ELSE k * 100 >= (stop - start + 1) * 90 END""",
    "coverage_split": f"""WITH {_INTERVALS}, w AS (SELECT DISTINCT user_id, unnest(range(start, stop + 1)) AS line FROM iv WHERE event_id % 2 = 0),
v AS (SELECT DISTINCT user_id, unnest(range(start, stop + 1)) AS line FROM iv WHERE event_id % 2 = 1),
k AS (SELECT w.user_id, w.line, CASE WHEN v.line IS NULL THEN 'new' ELSE 'reused' END AS kind FROM w LEFT JOIN v USING (user_id, line)),
i AS (SELECT *, line - row_number() OVER (PARTITION BY user_id, kind ORDER BY line) AS isl FROM k)
SELECT user_id, kind, min(line)::BIGINT AS start, max(line)::BIGINT AS stop FROM i GROUP BY user_id, kind, isl""",
    "coverage_ranges": f"""WITH {_L}, i AS (SELECT document_id, line_number, line_number - row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS isl FROM l WHERE length(trim(text)) > 0)
SELECT document_id, min(line_number)::BIGINT AS start, max(line_number)::BIGINT AS stop FROM i GROUP BY document_id, isl""",
    "manifest_totals": " UNION ALL ".join(f"SELECT '{n}' AS pack, count(*) AS rows FROM {n}" for n in ("search_records", "search_lines", "activity_timelines", "i18n", "i18n_catalog", "read_chunks", "entities", "documents", "canonical_names")),
    "corpus_status": "SELECT game, document_type, count(*) AS documents, sum(line_count)::BIGINT AS lines, count(DISTINCT activity_id) AS activities FROM search_records GROUP BY ALL",
    "corpus_problems": f"""WITH {_L}, c AS (SELECT document_id, count(*) AS n FROM l GROUP BY document_id)
SELECT 'repeated id' AS problem, document_id AS id FROM search_records GROUP BY document_id HAVING count(*) > 1
UNION ALL SELECT 'line count', r.document_id FROM search_records r LEFT JOIN c USING (document_id) WHERE coalesce(n, 0) != line_count
UNION ALL SELECT 'orphan lines', document_id FROM c WHERE document_id NOT IN (SELECT document_id FROM search_records)
UNION ALL SELECT 'dangling link', x FROM (SELECT previous_document_id AS x FROM search_records UNION SELECT next_document_id FROM search_records) WHERE x IS NOT NULL AND x NOT IN (SELECT document_id FROM search_records)""",
    "missing_required": "SELECT c_custkey::BIGINT AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "snapshot_roundtrip": "SELECT document_id, display_title, line_count::BIGINT AS line_count FROM search_records",
    "snapshot_digest": "SELECT count(*) AS rows, 1::BIGINT AS same FROM search_records",
}
