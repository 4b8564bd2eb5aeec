"""The registered queries as SQL over the driver's tables, for comparison."""

from __future__ import annotations

from lectern import canon
from lectern.functions.numerals import EN_TENS, EN_UNITS, KO_DIGITS
from lectern.functions.references import SPACE
from lectern.operators.scan import FORBIDDEN
from lectern.plans import speech
from lectern.plans.stand_ins import LOST, OVERSIZE, REPEAT_SECONDS, SESSIONS


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


BOOKS = f"books(ord, abbrev, en, ko, code) AS ({_values(canon.BOOKS)})"
ALIASES = f"aliases(n, alias, abbrev) AS ({_values([(i, a, b) for i, (a, b) in enumerate(canon.ALIASES)])})"
LINES = f"""{BOOKS}, parts AS (
  SELECT b.abbrev, CASE WHEN lang IN ('en', 'fr') THEN 'en' ELSE 'ko' END AS side, string_split(text, chr(10)) AS t,
    CAST(row_number() OVER (PARTITION BY b.abbrev, coalesce(lang IN ('en', 'fr'), false) ORDER BY doc_id) AS INT) AS ch
  FROM documents JOIN books b ON b.ord = coalesce(TRY_CAST(substr(source, 4) AS INT), 0) % 66 + 1 WHERE text IS NOT NULL
), lines AS (SELECT abbrev, side, ch, CAST(generate_subscripts(t, 1) AS INT) AS v, unnest(t) AS text FROM parts)"""
VERSES = f"""{LINES}, verses AS (
  SELECT abbrev, ch, v, coalesce(k.text, '') AS ko, coalesce(e.text, '') AS en
  FROM (SELECT * FROM lines WHERE side = 'ko') k FULL JOIN (SELECT * FROM lines WHERE side = 'en') e USING (abbrev, ch, v)
)"""
ORDERS = f"""{ALIASES}, o AS (
  SELECT o_orderkey, o_orderkey % 37 + 1 AS c, o_orderkey % 5 + 1 AS v, o_orderkey % 5 + o_orderkey % 4 AS w, CAST(o_orderkey % 199 + 1 AS INT) AS m,
    a.alias, a.abbrev, b.en, b.ko, upper(a.alias) AS big
  FROM orders JOIN aliases a ON a.n = o_orderkey % 369 JOIN books b ON b.abbrev = a.abbrev
)"""


def _forms(of: int, *forms: str) -> str:
    return f"CASE o_orderkey % {of} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


TYPED = f"""{ORDERS}, typed AS (SELECT o_orderkey, {_forms(
    9, "alias || ' ' || c || ':' || v", "alias || ' ' || c || ':' || v || '-' || w", "big || '. ' || c || ' ' || v", "'  ' || alias || ' ' || c || ' ： ' || v || ' ～ ' || w || ' '",
    "alias || ' ' || c", "alias || ' ' || c || ' ' || v || ' - ' || w", "alias || ' ' || c || ':' || v || ' - ' || w", "en || ' ' || c || ':' || v",
    "CASE WHEN o_orderkey % 18 = 8 THEN '  ' ELSE alias || c END")} AS raw FROM o)"""


def _numbers(text: str) -> str:
    """ch, v1, v2 of a tail; ch is null where it has no form."""
    colon, spaced, only = r"'^(\d+):(\d+)(?:-(\d+))?$'", r"'^(\d+)\s+(\d+)(?:\s*-\s*(\d+)|\s+(\d+))?$'", r"'^(\d+)$'"
    part = lambda p, i: f"CAST(nullif(regexp_extract({text}, {p}, {i}), '') AS BIGINT)"
    return (
        f"coalesce({part(colon, 1)}, {part(spaced, 1)}, {part(only, 1)}) AS ch, coalesce({part(colon, 2)}, {part(spaced, 2)}) AS v1, "
        f"coalesce({part(colon, 3)}, {part(spaced, 3)}, {part(spaced, 4)}) AS v2"
    )


_KEY = f"CASE WHEN regexp_matches(name, '[가-힣]') THEN name ELSE regexp_replace(lower(name), '{SPACE}|[.\\-]', '', 'g') END"
PARSED = f"""{TYPED}, cut AS (
  SELECT o_orderkey, raw, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(raw, '^{SPACE}+|{SPACE}+$', '', 'g'),
    '{SPACE}*[：:]{SPACE}*', ':', 'g'), '{SPACE}*[–—~～]{SPACE}*', '-', 'g'), '{SPACE}+') AS t FROM typed
), prefixes AS (
  SELECT o_orderkey, l, array_to_string(t[1:l], ' ') AS name, array_to_string(t[l+1:], ' ') AS rest FROM cut, (VALUES (1), (2), (3), (4)) x(l) WHERE len(t) > l
), tried AS (SELECT o_orderkey, l, {_KEY} AS alias, {_numbers("rest")} FROM prefixes
), best AS (
  SELECT o_orderkey, max_by(abbrev, l) AS abbrev, max(struct_pack(l := l, ch := ch, v1 := v1, v2 := v2)) AS r
  FROM tried JOIN aliases USING (alias) WHERE ch IS NOT NULL GROUP BY o_orderkey
), parsed AS (SELECT t.o_orderkey, t.raw, b.abbrev, b.r.ch AS ch, b.r.v1 AS v1, b.r.v2 AS v2 FROM typed t LEFT JOIN best b USING (o_orderkey))"""
RANGE = "coalesce(nullif(v1, 0), 1) AS lo, coalesce(nullif(v2, 0), nullif(v1, 0), 2147483647) AS hi"
SOURCE = f"""{LINES}, source AS (
  SELECT CAST(ord AS BIGINT) * 1000000000 + ch * 100000 + v AS line_no, (CASE WHEN v % 13 = 0 THEN '# ' ELSE '' END) || (CASE WHEN ch % 11 = 0 THEN 'TOB' ELSE code END) || ' '
    || ch || ':' || (CASE WHEN ch % 5 = 0 AND v % 7 = 3 THEN v + 1 ELSE v END) || ' [' || text || ']  ¶' AS value
  FROM lines JOIN books USING (abbrev) WHERE side = 'en'
), rows AS (
  SELECT line_no, regexp_extract(value, '^(\\w{{3}}) (\\d+):(\\d+) (.*)$', ['code', 'ch', 'v', 'text']) AS m FROM source
), vpl AS (
  SELECT line_no, m.code AS code, abbrev, CAST(m.ch AS INT) AS ch, CAST(m.v AS INT) AS v,
    trim(regexp_replace(translate(m.text, '[]¶', ''), '\\s+', ' ', 'g')) AS text
  FROM rows JOIN books ON books.code = m.code
)"""
PATH = "CASE WHEN doc_id % 7 = 0 THEN 'data/sample/' || doc_id WHEN doc_id % 11 = 0 THEN 'x/nkjv_' || doc_id WHEN doc_id % 13 = 0 THEN doc_id || '.bak' ELSE 'texts/' || doc_id || '.txt' END"
FILES = f"files AS (SELECT {PATH} AS path, text, CAST(strlen(text) AS BIGINT) AS length FROM documents)"
NAMED = f"regexp_matches(path, {_text(FORBIDDEN.replace(chr(92) + 'z', '$'))})"
NAMES_FOUND = f"SELECT path, 'name' AS kind, '' AS detail FROM files WHERE {NAMED}"
SIGNATURES_FOUND = "SELECT path, 'signature' AS kind, s.text AS detail FROM {} f JOIN (SELECT DISTINCT text FROM benchmark WHERE text <> '') s ON contains(f.text, s.text)"
SIZES_FOUND = "SELECT path, 'size' AS kind, coalesce(CAST(length AS VARCHAR), 'unreadable') AS detail FROM {} WHERE (length IS NULL OR length > " + str(OVERSIZE) + ") AND NOT starts_with(path, 'data/sample/')"
REPORT = f"{FILES}, rest AS (SELECT * FROM files WHERE NOT {NAMED}), report AS ({NAMES_FOUND} UNION ALL {SIGNATURES_FOUND.format('rest')} UNION ALL {SIZES_FOUND.format('rest')})"
_ONES = "CASE WHEN {0} = 0 OR {0} = {1} THEN '' ELSE substr('" + KO_DIGITS + "', CAST({0} AS INT), 1) END"


def _ko_word(n: str) -> str:
    tens = f"CASE WHEN {n} % 100 >= 10 THEN {_ONES.format(f'({n} // 10 % 10)', 1)} || '십' ELSE '' END"
    return f"(CASE WHEN {n} >= 200 THEN {_ONES.format(f'({n} // 100)', 1)} || '백' WHEN {n} >= 100 THEN '백' ELSE '' END) || ({tens}) || ({_ONES.format(f'({n} % 10)', -1)})"


def _en_word(n: str) -> str:
    units, tens = "[" + ", ".join(map(_text, EN_UNITS)) + "]", "[" + ", ".join(map(_text, EN_TENS)) + "]"
    rest = f"CASE WHEN {n} % 100 = 0 THEN '' WHEN {n} % 100 < 20 THEN {units}[{n} % 100] WHEN {n} % 10 = 0 THEN {tens}[{n} % 100 // 10 - 1] ELSE {tens}[{n} % 100 // 10 - 1] || ' ' || {units}[{n} % 10] END"
    return f"trim((CASE WHEN {n} >= 100 THEN {units}[{n} // 100] || ' hundred ' ELSE '' END) || ({rest}))"


_WORDS = {f"k{n}": f"({_ko_word(n)})" for n in "cvm"} | {f"e{n}": f"({_en_word(n)})" for n in "cvm"}
DETECTED, DETECTED_WORDS = (f"{BOOKS}, {ORDERS}, {speech.as_sql(which, _WORDS)}" for which in (speech.DIGITS, speech.WORDS))
#: Sentences as they were said and as a machine wrote them down, with what is in both and which of it is matched.
_SHIFTED = f"heard AS (SELECT * REPLACE (CASE WHEN o_orderkey % {speech.MISHEARD[0]} = {speech.MISHEARD[1]} THEN c + 1 ELSE c END AS c) FROM o)"
EVALUATED = f"""{DETECTED}, {_SHIFTED}, {speech.as_sql(speech.DIGITS, _WORDS, 'heard', 'misheard')}, truth AS (SELECT o_orderkey, abbrev, ch, coalesce(v1, -1) AS v, count(*) AS n FROM expected GROUP BY 1, 2, 3, 4),
  heard_refs AS (SELECT o_orderkey, abbrev, ch, coalesce(v1, -1) AS v, count(*) * any_value(CASE WHEN o_orderkey % {speech.REPEATED[0]} = {speech.REPEATED[1]} THEN 2 ELSE 1 END) AS n FROM misheard GROUP BY 1, 2, 3, 4),
  found AS (SELECT 'said' AS mode, * FROM truth UNION ALL SELECT 'machine', * FROM heard_refs),
  pairs AS (SELECT m.mode, coalesce(sum(CASE WHEN f.n IS NOT NULL AND t.o_orderkey % 8 <= 5 THEN least(t.n, f.n) END), 0) AS tp FROM (VALUES ('said'), ('machine')) m(mode) CROSS JOIN truth t LEFT JOIN found f
    ON f.mode = m.mode AND f.o_orderkey = t.o_orderkey AND f.abbrev = t.abbrev AND f.ch = t.ch AND f.v = t.v GROUP BY m.mode),
  sums AS (SELECT mode, CAST(tp AS BIGINT) AS tp, CAST((SELECT sum(n) FROM found f WHERE f.mode = p.mode) - tp AS BIGINT) AS fp, CAST((SELECT sum(n) FROM truth) - tp AS BIGINT) AS fn FROM pairs p)"""
FOUND = 'o_orderkey, item, abbrev, ch, v1, ch2, v2, matched, start, "end"'
_SAID = _ko_word("m")
#: What the stand-in sentences are in the one form.
NORMALISED = f"""{BOOKS}, {ORDERS} SELECT o_orderkey, {_forms(
    5, "ko || ' ' || m || '장 ' || v || '절'", "ko || ' ' || c || '편 ' || m || '절 말씀'", "ko || ' ' || c || ':' || v || '-' || w", "ko || ' ' || c || '장 ' || v || '절-' || w || '절'", f"{_SAID} || ' ' || ko || ':' || c")} AS text FROM o"""
GAP = f"INTERVAL {REPEAT_SECONDS} SECONDS"
CATALOG = f"""{LINES}, places AS (SELECT DISTINCT abbrev, ch, v FROM lines), catalog AS (
  SELECT *, lead(ch) OVER b AS next_ch, lead(v) OVER b AS next_v, CASE WHEN lag(ch) OVER b = ch THEN lag(v) OVER b END AS previous_v
  FROM places WINDOW b AS (PARTITION BY abbrev ORDER BY ch, v)
)"""
PHRASES = f"""{CATALOG}, {ALIASES}, o AS (
  SELECT o_orderkey, CAST(o_orderkey % 37 + 1 AS INT) AS c, CAST(o_orderkey % 5 + 1 AS INT) AS v, o_orderkey % 5 + o_orderkey % 4 AS w, a.abbrev, b.ko FROM orders JOIN aliases a ON a.n = o_orderkey % 369 JOIN books b ON b.abbrev = a.abbrev
), texts AS (SELECT * FROM o
), kinds AS (SELECT o_orderkey, {_forms(12, "'verse'", "'next'", "'previous'", "'next_chapter'", "'chapter'", "'same_chapter'", "'return'", "NULL", "NULL", "'verse'", "'next'", "'return'")} AS kind,
    CAST({_forms(12, "v", "NULL", "NULL", "NULL", "c", "v", "v", "NULL", "NULL", "v", "NULL", "w")} AS INT) AS n FROM o WHERE o_orderkey % 12 NOT IN (7, 8)
), asked AS (SELECT k.*, t.abbrev, t.c AS ch, t.v FROM kinds k LEFT JOIN texts t ON t.o_orderkey = k.o_orderkey AND t.o_orderkey % 4 <> 0
), moved AS (SELECT a.*, k.abbrev AS at, CASE kind WHEN 'next' THEN k.next_ch WHEN 'next_chapter' THEN a.ch + 1 WHEN 'chapter' THEN n ELSE a.ch END AS to_ch,
    CASE WHEN kind = 'next' THEN k.next_v WHEN kind = 'previous' THEN k.previous_v WHEN kind IN ('next_chapter', 'chapter') THEN 1 ELSE n END AS to_v,
    coalesce(kind = 'next' AND k.next_ch <> a.ch, false) AS rolled_over
  FROM asked a LEFT JOIN catalog k ON k.abbrev = a.abbrev AND k.ch = a.ch AND k.v = a.v
), looked AS (SELECT m.*, p.abbrev IS NOT NULL AS found FROM moved m LEFT JOIN places p ON m.at IS NOT NULL AND p.abbrev = m.abbrev AND p.ch = m.to_ch AND p.v = m.to_v)"""
SQL = {
    "parse_ref": f"WITH {BOOKS}, {PARSED} SELECT * FROM parsed",
    "parse_chverse": f"WITH {BOOKS}, {ORDERS}, tails AS (SELECT o_orderkey, {_forms(9, *(x.replace('+', '||') for x in ("c + ':' + v", "c + ' ' + v", "c + ':' + v + '-' + w", "c + ' ' + v + ' ' + w", "c + ''", "c + ' ' + v + ' - ' + w", "'x ' + c", "c + ':' + v + '-'", "c + ':' + v + ',' + w")))} AS tail FROM o) SELECT o_orderkey, tail, {_numbers('tail')} FROM tails",
    "resolve_alias": f"WITH {BOOKS}, {ORDERS}, named AS (SELECT o_orderkey, {_forms(5, 'alias', 'big', "alias || '.'", 'en', "'x' || alias")} AS name FROM o), keyed AS (SELECT o_orderkey, name, {_KEY} AS alias FROM named) SELECT o_orderkey, name, abbrev FROM keyed LEFT JOIN aliases USING (alias)",
    "corpus_long": f"WITH {LINES} SELECT side, abbrev, ch, v, text FROM lines",
    "parallel_align": f"WITH {VERSES} SELECT * FROM verses",
    "chapter_merge": f"WITH {LINES} SELECT ord, abbrev AS a, en, ko, CAST(coalesce(max(ch), 0) AS INT) AS chapters, CAST(count(*) FILTER (side = 'ko') AS INT) AS ko_verses, CAST(count(*) FILTER (side = 'en') AS INT) AS en_verses FROM books LEFT JOIN lines USING (abbrev) GROUP BY ord, abbrev, en, ko",
    "lookup_range": f"WITH {VERSES}, {PARSED}, wanted AS (SELECT *, {RANGE} FROM parsed WHERE ch > 0) SELECT w.o_orderkey, w.abbrev, w.ch, s.v AS num, s.ko, s.en FROM wanted w JOIN verses s ON s.abbrev = w.abbrev AND s.ch = w.ch AND s.v BETWEEN w.lo AND w.hi",
    "lookup_shown": f"""WITH {VERSES}, {PARSED}, wanted AS (SELECT *, {RANGE} FROM parsed WHERE ch > 0)
      SELECT w.o_orderkey, string_agg(CAST(s.v AS VARCHAR), ',' ORDER BY s.v) AS nums, string_agg(s.ko, chr(10) ORDER BY s.v) AS ko, string_agg(s.en, chr(10) ORDER BY s.v) AS en
      FROM wanted w JOIN verses s ON s.abbrev = w.abbrev AND s.ch = w.ch AND s.v BETWEEN w.lo AND w.hi GROUP BY w.o_orderkey""",
    "lookup_status": f"""WITH {VERSES}, {PARSED}, wanted AS (SELECT *, {RANGE} FROM parsed), counted AS (
        SELECT w.o_orderkey, count(s.v) AS n FROM wanted w LEFT JOIN verses s ON s.abbrev = w.abbrev AND s.ch = w.ch AND s.v BETWEEN w.lo AND w.hi GROUP BY 1
      ) SELECT o_orderkey, raw, CASE WHEN trim(raw) = '' THEN 'noop' WHEN p.abbrev IS NULL THEN 'bad_format' WHEN n > 0 THEN 'ok' ELSE 'not_found' END AS status,
        CASE WHEN p.abbrev IS NULL THEN NULL WHEN n > 0 THEN b.en || ' ' || ch || coalesce(':' || nullif(v1, 0) || coalesce('–' || nullif(v2, 0), ''), '')
          ELSE p.abbrev || ' ' || ch || coalesce(':' || nullif(v1, 0), '') END AS label
      FROM parsed p JOIN counted USING (o_orderkey) LEFT JOIN books b ON b.abbrev = p.abbrev""",
    "lookup_header": f"""WITH {VERSES}, {PARSED}, wanted AS (SELECT *, {RANGE} FROM parsed),
      there AS (SELECT DISTINCT w.o_orderkey FROM wanted w JOIN verses s ON s.abbrev = w.abbrev AND s.ch = w.ch AND s.v BETWEEN w.lo AND w.hi)
      SELECT o_orderkey, b.en || ' ' || ch || coalesce(':' || nullif(v1, 0) || coalesce('–' || nullif(v2, 0), ''), '') AS label, b.ko || ' · ' || b.en AS names, 'K' AS ko_label, 'E' AS en_label
      FROM parsed p JOIN there USING (o_orderkey) JOIN books b ON b.abbrev = p.abbrev""",
    "build_separate": f"WITH {VERSES} SELECT * FROM verses",
    "corpus_view": """SELECT n_name AS title, n_nationkey % 5 = 0 AS demo_badge, ['ko+en', 'ko', 'en'][n_nationkey % 3 + 1] AS layout,
      CASE WHEN n_nationkey % 2 = 0 THEN 'K ' || n_name ELSE '' END AS ko_label, CASE WHEN n_nationkey % 2 = 0 THEN 'E' ELSE n_name END AS en_label FROM nation""",
    "ko_only_view": f"WITH {VERSES} SELECT abbrev, ch, v, replace(replace(replace(CASE ko WHEN '' THEN '—' ELSE ko END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS ko_html, ko = '' AS ko_empty FROM verses",
    "scan_decoded": f"WITH {FILES} {SIGNATURES_FOUND.format('files')}",
    "context_phrases": f"""WITH {PHRASES} SELECT o_orderkey, kind, abbrev, CAST(to_ch AS INT) AS to_ch, CAST(to_v AS INT) AS to_v, rolled_over,
      (60 + CASE WHEN o_orderkey % 12 IN (0, 1) THEN 20 ELSE 0 END - CASE WHEN rolled_over THEN 20 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM looked WHERE found""",
    "context_misses": f"WITH {PHRASES} SELECT o_orderkey, kind, n, CASE WHEN abbrev IS NULL THEN 'no_context' ELSE 'not_there' END AS reason FROM looked WHERE NOT found",
    "resolver_gate": f"""WITH {DETECTED}, n AS (SELECT o_orderkey, count(DISTINCT (abbrev, coalesce(ch, 0), coalesce(v1, 0))) AS n FROM expected GROUP BY 1)
      SELECT o_orderkey AS key FROM spoken LEFT JOIN n USING (o_orderkey) WHERE ({' OR '.join(f"contains(text, {_text(t)})" for t in speech.TRIGGERED)}) AND coalesce(n, 0) <> 1""",
    "latency_jsonl": "SELECT event_type AS hop, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "render_rows": f"WITH {VERSES} SELECT abbrev, ch, v, " + ", ".join(f"replace(replace(replace(CASE {s} WHEN '' THEN '—' ELSE {s} END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS {s}_html, {s} = '' AS {s}_empty" for s in ("ko", "en")) + " FROM verses",
    "en_only_view": f"WITH {VERSES} SELECT abbrev, ch, v, replace(replace(replace(CASE en WHEN '' THEN '—' ELSE en END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS en_html, en = '' AS en_empty FROM verses",
    "clean_text": "SELECT item_id, trim(regexp_replace(translate('[  ' || replace(text, ' ', ' ' || chr(9)) || ']  ¶', '[]¶', ''), '\\s+', ' ', 'g')) AS clean FROM benchmark",
    "vpl_parse": f"WITH {SOURCE} SELECT * FROM vpl",
    "verse_order_check": f"WITH {SOURCE}, seen AS (SELECT *, CAST(row_number() OVER (PARTITION BY code, ch ORDER BY line_no) AS INT) AS expected FROM vpl) SELECT code, ch, line_no, v, expected FROM seen WHERE v <> expected",
    "missing_books": f"WITH {LINES} SELECT ord, abbrev, en FROM books ANTI JOIN lines USING (abbrev)",
    "chapter_gap_pad": f"WITH {LINES}, kept AS (SELECT side, abbrev, ch, count(*) AS n FROM lines WHERE ch % 3 <> 0 GROUP BY 1, 2, 3), every AS (SELECT side, abbrev, CAST(unnest(generate_series(1, max(ch))) AS INT) AS ch FROM kept GROUP BY side, abbrev) SELECT side, abbrev, ch, CAST(coalesce(n, 0) AS INT) AS n FROM every LEFT JOIN kept USING (side, abbrev, ch)",
    "corpus_counts": f"WITH {VERSES} SELECT count(DISTINCT abbrev) AS books, count(DISTINCT (abbrev, ch)) AS chapters, count(*) AS verses FROM verses",
    "last_wins": "SELECT source, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang, max_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source",
    "source_fallback": "SELECT doc_id, lang FROM documents WHERE lang = 'none' UNION ALL SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'none')",
    "js_roundtrip": f"WITH {VERSES} SELECT * FROM verses",
    "json_combined": f"WITH {VERSES} SELECT count(DISTINCT abbrev) AS books, count(DISTINCT (abbrev, ch)) AS chapters, count(*) AS verses FROM verses",
    "scan_names": f"WITH {FILES} {NAMES_FOUND}",
    "scan_signatures": f"WITH {FILES} {SIGNATURES_FOUND.format('files')}",
    "scan_size": f"WITH {FILES} {SIZES_FOUND.format('files')}",
    "scan_report": f"WITH {REPORT} SELECT * FROM report",
    "scan_verdict": f"WITH {REPORT} SELECT (SELECT count(*) FROM files) AS checked, count(*) AS violations, count(*) > 0 AS blocked FROM report",
    "numerals_ko": f"SELECT o_orderkey, {_ko_word('n')} AS word, CAST(n AS INT) AS value FROM (SELECT o_orderkey, o_orderkey % 200 + 1 AS n FROM orders)",
    "numerals_en": f"SELECT o_orderkey, {_en_word('n')} AS word, CAST(n AS INT) AS value FROM (SELECT o_orderkey, o_orderkey % 200 + 1 AS n FROM orders)",
    "normalize_text": f"WITH {NORMALISED}",
    "detect_refs": f"WITH {DETECTED} SELECT {FOUND} FROM expected",
    "detect_offsets": f"WITH {DETECTED_WORDS} SELECT {FOUND}, matched AS shown FROM expected",
    "detect_special": f"""WITH {LINES}, {ORDERS}, said AS (SELECT o_orderkey, abbrev, CAST(c AS INT) AS ch, CAST(v AS INT) AS v, o_orderkey % 5 AS form FROM o WHERE o_orderkey % 5 < 4),
      ends AS (SELECT abbrev, ch, max(v) AS last FROM lines GROUP BY 1, 2)
      SELECT o_orderkey, s.abbrev, s.ch, CAST(CASE form WHEN 0 THEN s.v WHEN 3 THEN last ELSE 1 END AS INT) AS v1, form = 0 AS open_range FROM said s LEFT JOIN ends e ON e.abbrev = s.abbrev AND e.ch = s.ch""",
    "confidence_rank": f"""WITH {DETECTED} SELECT o_orderkey, start, item, confidence, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY confidence DESC, start, item) AS INT) AS rank FROM expected""",
    "context_asof": "SELECT e.event_id, e.user_id, s.event_id AS context FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s ON e.user_id = s.user_id AND e.ts > s.ts",
    "relative_resolve": f"""WITH {CATALOG}, mentions AS (SELECT *, ['verse', 'next', 'previous', 'next_chapter', 'same_chapter'][(v + ch) % 5 + 1] AS kind, v % 4 + 1 AS n FROM catalog),
      moved AS (SELECT abbrev, ch, v, kind, n, CASE kind WHEN 'next' THEN next_ch WHEN 'next_chapter' THEN ch + 1 ELSE ch END AS to_ch,
        CASE kind WHEN 'next' THEN next_v WHEN 'previous' THEN previous_v WHEN 'next_chapter' THEN 1 ELSE n END AS to_v, kind = 'next' AND next_ch <> ch AS rolled_over FROM mentions)
      SELECT * FROM moved m WHERE to_v IS NOT NULL AND EXISTS (SELECT 1 FROM places a WHERE a.abbrev = m.abbrev AND a.ch = m.to_ch AND a.v = m.to_v)""",
    "suppress_gap": f"SELECT event_id, user_id, event_type, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < {GAP}, false) AS suppressed FROM events",
    "suppress_throttle": f"""WITH RECURSIVE emitted AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
        UNION ALL SELECT e.user_id, e.event_type, min(e.ts) FROM emitted l JOIN events e ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.ts >= l.ts + {GAP} GROUP BY e.user_id, e.event_type, l.ts)
      SELECT e.user_id, e.event_type, e.event_id, l.ts IS NOT NULL AS emitted FROM events e LEFT JOIN emitted l ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.ts = l.ts""",
    "stream_candidates": f"""WITH {VERSES}, {DETECTED.removeprefix(BOOKS + ', ')} SELECT o_orderkey % {SESSIONS} AS session, o_orderkey // {SESSIONS} AS seq, item, o_orderkey % 2 = 0 AS final, abbrev, ch,
      greatest(1, coalesce(v1, 1)) AS v, start, "end", ko, en FROM expected e JOIN verses s USING (abbrev, ch) WHERE s.v = greatest(1, coalesce(e.v1, 1)) AND o_orderkey % {LOST[0]} <> {LOST[1]}""",
    "resolver_answers": """WITH asked AS (SELECT user_id AS session, event_id AS seq FROM events WHERE event_type = 'view'),
      answers AS (SELECT session, seq, seq % 9 * 10 + seq % 2 AS wait, ['gn', 'ex', 'xx'][seq % 3 + 1] AS abbrev, CAST(seq % 4 + 1 AS INT) AS ch, CAST(unnest(CASE WHEN seq % 4 = 0 THEN [] WHEN seq % 5 = 0 THEN [1, 2] ELSE [1] END) AS INT) AS v FROM asked)
      SELECT a.session, a.seq, CASE WHEN wait IS NULL THEN 'never' WHEN wait <= 1.5 THEN 'in_time' ELSE 'late' END AS outcome, abbrev, ch, v FROM asked a LEFT JOIN answers w ON w.session = a.session AND w.seq = a.seq AND wait <= 60""",
    "latency_stamps": """WITH rows AS (SELECT event_id, event_type, user_id AS session, epoch_us(ts) AS t, user_id % 11 * 1000000 - 5000000 + epoch_us(ts) // 86400000000 % 3 * 1000 AS off FROM events),
      pings AS (SELECT session, t, event_id, (((t + 20000 + event_id % 7 * 1000) - (t + off)) + ((t + 30000) - (t + off + 50000))) / 2 AS o FROM rows WHERE event_type = 'click'),
      offsets AS (SELECT session, t, event_id, median(o) OVER (PARTITION BY session ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS o FROM pings),
      last_of AS (SELECT session, t, max_by(o, event_id) AS o FROM offsets GROUP BY 1, 2),
      messages AS (SELECT event_id, session, t, off, t + 40000 + event_id % 5 * 10000 AS recv, t + 90000 + event_id % 3 * 1000 AS sent FROM rows WHERE event_type <> 'click'),
      valid AS (SELECT m.*, p.o FROM messages m ASOF JOIN last_of p ON m.session = p.session AND m.recv >= p.t),
      hops AS (SELECT 'received' AS hop, (recv - (t + off + o)) / 1000.0::DOUBLE AS ms FROM valid UNION ALL SELECT 'answered', (sent - recv) / 1000.0::DOUBLE FROM valid UNION ALL SELECT 'rendered', (t + off + 150000 + o - sent) / 1000.0::DOUBLE FROM valid)
      SELECT hop, count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, max(ms) AS max_ms FROM hops GROUP BY hop""",
    "interim_final": "SELECT user_id, event_id % 7 AS ref, min(event_id) AS first_seq, max(event_id) AS last_seq, bool_or(event_type = 'purchase') AS confirmed, sha256(user_id || '|' || event_id % 7 || '|' || min(event_id)) AS id FROM events GROUP BY user_id, event_id % 7",
    "top5": """WITH l AS (SELECT user_id, event_id, event_type, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events WHERE event_type <> 'purchase' QUALIFY place <= 5)
      SELECT user_id, event_id, event_type, place, EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = l.user_id AND p.event_id % 7 = l.event_id % 7 AND p.ts >= l.ts) AS displayed FROM l""",
    "candidate_union": f"""WITH {LINES}, {ORDERS}, parts_of AS (SELECT o_orderkey % 6 AS p, o_orderkey % 100 AS o_orderkey, abbrev, CAST(c AS INT) AS ch, CAST(v AS INT) AS v FROM o),
      every AS (SELECT *, 0 AS r FROM parts_of WHERE p BETWEEN 0 AND 3 UNION ALL SELECT *, 1 FROM parts_of WHERE p BETWEEN 2 AND 4 UNION ALL SELECT *, 2 FROM parts_of WHERE p BETWEEN 3 AND 5)
      SELECT o_orderkey, abbrev, ch, v, ['rule', 'context', 'llm'][min(r) + 1] AS source FROM every SEMI JOIN lines USING (abbrev, ch, v) GROUP BY 1, 2, 3, 4""",
    "latency_summary": "SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "clock_offset": "SELECT user_id, median(((value - 0.0::DOUBLE) + ((value + 2) - value / 2)) / 2) AS \"offset\" FROM events GROUP BY user_id",
    "eval_prf": f"WITH {EVALUATED} SELECT mode, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (2 * tp + fp + fn)) AS f1 FROM sums",
    "eval_topk": f"""WITH {EVALUATED}, twice AS (SELECT m.*, unnest(CASE WHEN o_orderkey % {speech.REPEATED[0]} = {speech.REPEATED[1]} THEN [0, 1] ELSE [0] END) AS again FROM misheard m),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY confidence DESC, again, start, item) AS rank FROM twice),
      best AS (SELECT o_orderkey, abbrev, ch, coalesce(v1, 0) AS v, min(rank) AS rank FROM ranked GROUP BY 1, 2, 3, 4)
      SELECT count(*) AS n, avg(CAST(coalesce(rank <= 1, false) AS INT)) AS top1, avg(CAST(coalesce(rank <= 3, false) AS INT)) AS top3
      FROM expected e LEFT JOIN best b ON b.o_orderkey = e.o_orderkey AND b.abbrev = e.abbrev AND b.ch = e.ch AND b.v = coalesce(e.v1, 0)""",
    "fp_per_hour": f"""WITH {EVALUATED}, ends AS (SELECT min(o_orderkey * 60) AS a, max(o_orderkey * 60) AS b FROM expected), last AS (SELECT max(o_orderkey * 60 + o_orderkey % 8) AS b FROM expected),
      each AS (SELECT mode, fp AS false_positives, (greatest(ends.b, last.b) - ends.a) / 3600.0::DOUBLE AS hours FROM sums, ends, last), rates AS (SELECT *, false_positives / hours AS per_hour FROM each)
      SELECT *, per_hour - (SELECT per_hour FROM rates WHERE mode = 'said') AS over_base FROM rates""",
    "match_in_time": "WITH l AS (SELECT DISTINCT user_id AS session, event_id % 3 AS ref, ts AS label_ts FROM events WHERE event_type = 'purchase') SELECT *, EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'view' AND e.user_id = l.session AND e.event_id % 3 = l.ref AND abs(epoch_us(e.ts) - epoch_us(l.label_ts)) <= 3600000000) AS matched FROM l",
    "fixture_drift": "(SELECT *, 'left' AS side FROM (SELECT source, lang FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT source, lang FROM documents WHERE doc_id % 2 = 1)) UNION ALL (SELECT *, 'right' FROM (SELECT source, lang FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT source, lang FROM documents WHERE doc_id % 2 = 0))",
    "stream_session": f"""WITH RECURSIVE ev AS (SELECT user_id AS session, event_id, ts, event_id % 7 AS ref, CASE WHEN event_type = 'error' THEN 'clear' WHEN event_type IN ('click', 'purchase') THEN 'display' ELSE 'mention' END AS kind FROM events),
      phased AS (SELECT *, count(*) FILTER (kind = 'clear') OVER (PARTITION BY session ORDER BY ts, event_id) AS phase FROM ev),
      shown AS (SELECT *, last_value(CASE WHEN kind = 'display' THEN ref END IGNORE NULLS) OVER (PARTITION BY session, phase ORDER BY ts, event_id) AS context FROM phased),
      m AS (SELECT * FROM shown WHERE kind = 'mention'),
      emitted AS (SELECT session, phase, ref, min(ts) AS ts FROM m GROUP BY 1, 2, 3
        UNION ALL SELECT m.session, m.phase, m.ref, min(m.ts) FROM emitted l JOIN m ON m.session = l.session AND m.phase = l.phase AND m.ref = l.ref AND m.ts >= l.ts + {GAP} GROUP BY m.session, m.phase, m.ref, l.ts)
      SELECT m.session, event_id, m.ref, context, e.ts IS NOT NULL AS emitted FROM m LEFT JOIN emitted e ON m.session = e.session AND m.phase = e.phase AND m.ref = e.ref AND m.ts = e.ts""",
}
