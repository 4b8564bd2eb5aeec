"""The queries that SQL can express, over the driver's tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filters(rules: list[dict]) -> str:
    """op1: the longest rule, else the decision of the class that canonical links and refreshes with whole urls make."""
    values = ", ".join(f"('{r['host']}', '{r['path']}', '{r['verdict']}')" for r in rules)
    parts = f"""coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path"""
    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) END AS rest"
    fits = "((t.host = r.host OR t.host LIKE '%.' || r.host) AND starts_with(t.path, r.path))"
    best = f"(SELECT {{}} FROM rules r WHERE {fits} ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.host || r.path LIMIT 1)"
    return f"""WITH RECURSIVE rules(host, path, verdict) AS (VALUES {values}),
    tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
    links AS (SELECT url AS a, CASE WHEN regexp_matches(tag, '(?is)^<link.*rel="?canonical') THEN regexp_extract(tag, '(?is)href="([^"]*)"', 1)
        WHEN regexp_matches(tag, '(?is)http-equiv="?refresh') THEN regexp_extract(tag, '(?is)url=([^"]*)', 1) END AS b FROM tags),
    edges AS (SELECT a, b FROM links WHERE b <> '' UNION SELECT b, a FROM links WHERE b <> ''),
    reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
    others AS (SELECT *, {parts} FROM (SELECT node, other, {rest.format('other')} FROM reach)),
    decided AS (SELECT node, {best.format('r.verdict')} AS verdict FROM others t),
    classes AS (SELECT node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict FROM decided GROUP BY node),
    own AS (SELECT page_id, url, {parts} FROM (SELECT page_id, url, {rest.format('url')} FROM pages)),
    judged AS (SELECT page_id, url, host, path, {best.format('r.host || r.path')} AS rule, {best.format('r.verdict')} AS verdict FROM own t)
    SELECT page_id, host, path, rule, coalesce(j.verdict, c.verdict, 'allow') AS verdict FROM judged j LEFT JOIN classes c ON c.node = j.url"""


def _base32(hexadecimal: str) -> str:
    """Base32 of forty hexadecimal digits: each five of them are four characters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = [f"CAST('0x' || substr({hexadecimal}, {i}, 5) AS BIGINT)" for i in range(1, 41, 5)]
    return " || ".join(f"substr('{alphabet}', CAST({x} // {32**p} % 32 AS INT) + 1, 1)" for x in five for p in (3, 2, 1, 0))


#: op9: digests, the response of each payload, and the place of each capture by URL key and time.
WARC = f"""WITH rows AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
    hashed AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM rows),
    keyed AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best, CASE WHEN url = '' THEN '' ELSE
        array_to_string(list_reverse(string_split(lower(regexp_extract(url, '(?s)^(?:[^:/?#]*://)?(?:www\\d*\\.)?([^/?#:]*)(?::\\d+)?([^#]*).*$', 1)), '.')), ',') || ')'
        || regexp_extract(url, '(?s)^(?:[^:/?#]*://)?(?:www\\d*\\.)?([^/?#:]*)(?::\\d+)?([^#]*).*$', 2) END AS url_key FROM hashed)
    SELECT page_id, payload_bytes, {_base32('hex')} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> best THEN best END AS refers_to, row_number() OVER (ORDER BY url_key, page_id % 253402300800, page_id) - 1 AS position FROM keyed"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """op12: the rounds one after the other; the remainder makes the division by the weight round down."""
    ends = f"position * len(v) // {parts}", f"(position + 1) * len(v) // {parts}"
    steps = []
    for k in range(rounds + 1):
        nearest = f"""near{k} AS MATERIALIZED (SELECT position, part, w, min({{'d': list_dot_product(part, part) - 2 * list_dot_product(part, centre) + list_dot_product(centre, centre), 'e': entry}}) AS best
          FROM distinct_parts JOIN book{k} USING (position) GROUP BY position, part, w)"""
        sums = f"""sums{k} AS (SELECT position, entry, i, CAST(sum(w * x) AS BIGINT) AS s, CAST(sum(w) AS BIGINT) AS n FROM (
          SELECT position, best.e AS entry, w, generate_subscripts(part, 1) AS i, unnest(part) AS x FROM near{k}) GROUP BY position, entry, i)"""
        book = f"""book{k + 1} AS MATERIALIZED (SELECT position, entry, coalesce(m.centre, b.centre) AS centre FROM book{k} b LEFT JOIN (
          SELECT position, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS centre FROM sums{k} GROUP BY position, entry) m USING (position, entry))"""
        steps += [nearest] if k == rounds else [nearest, sums, book]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pieces AS MATERIALIZED (SELECT r, vec_id, label, position, v[{ends[0]} + 1:{ends[1]}] AS part FROM kept, range({parts}) t(position)),
    distinct_parts AS MATERIALIZED (SELECT position, part, count(*) AS w FROM pieces GROUP BY position, part),
    seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
    book0 AS MATERIALIZED (SELECT position, entry, part AS centre FROM pieces JOIN seeds USING (r)),
    {", ".join(steps)},
    hashed AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY position, entry, i)) AS codebooks_sha256
      FROM (SELECT position, entry, generate_subscripts(centre, 1) AS i, unnest(centre) AS x FROM book{rounds})),
    coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', CAST(best.e AS INT)), '' ORDER BY position) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM pieces JOIN near{rounds} USING (position, part) GROUP BY r, vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, hashed"""


#: op13: CRC-32 by its table of 256 steps, over each distinct word once.
RESAMPLING = f"""WITH steps AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step FROM range(256) t(b)),
    taken AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    aimed AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
    words AS (SELECT doc_id, unnest(w) AS word FROM taken),
    known AS (SELECT word, hex(word) AS x FROM (SELECT word FROM words UNION SELECT word FROM aimed)),
    hashed AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(word) + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM known, steps),
    own AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY bucket),
    aim AS (SELECT bucket, count(*) AS n FROM aimed JOIN hashed USING (word) GROUP BY bucket),
    held AS (SELECT b AS bucket, CAST(coalesce(own.n, 0) AS DOUBLE) AS s, CAST(coalesce(aim.n, 0) AS DOUBLE) AS t FROM range(10000) r(b) LEFT JOIN own ON own.bucket = b LEFT JOIN aim ON aim.bucket = b),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM held) + 10000) / ((s + 1) * ((SELECT sum(t) FROM held) + 10000)))) AS BIGINT) AS gain FROM held),
    weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM taken LEFT JOIN weights USING (doc_id)),
    able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (doc_id)"""
