"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gleaner.llm import chat, pii, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"

OP2 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACE}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct({GRAMS.format(n=5)}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON r.doc_id = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(m) AS component_id, min(m) = s.doc_id AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s"""

OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d JOIN ns ON len(w) >= n),
h AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

OP6 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, unnest({GRAMS.format(n=35)}) AS g FROM d WHERE len(w) >= 35),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM c WHERE n > 1),
k AS (SELECT doc_id, q, t FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS t FROM d) ANTI JOIN gone USING (doc_id, q)),
j AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY q) AS t FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)"""

_LENGTH = "length({}) + len(regexp_extract_all({}, '\\\\')) + len(regexp_extract_all({}, '" + chat._ANGLE + "')) + len(regexp_extract_all({}, '" + chat._SQUARE + "'))"


def _escaped_length(column: str) -> str:
    return "(" + _LENGTH.format(*[column] * 4) + ")"


OP7 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum({len(chat.START) + len(chat.END) + 2} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

_KEY = f"translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}')"

OP8 = f"""WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest({GRAMS.format(n=5)}) AS g FROM d WHERE len(w) >= 5),
rr AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM r) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM rr) GROUP BY doc_id),
ln AS (SELECT doc_id, host, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
lk AS (SELECT doc_id, host, line, i, {_KEY} AS k, len(regexp_extract_all(line, '{SPACE}')) AS n FROM ln),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lk WHERE n > 0 GROUP BY doc_id),
one AS (SELECT host, text, min(doc_id) AS doc_id FROM d GROUP BY host, text),
bad AS (SELECT lk.host, k FROM lk SEMI JOIN one USING (doc_id) WHERE n > 0 GROUP BY lk.host, k HAVING count(DISTINCT doc_id) >= 10),
t AS (SELECT lk.*, b.k IS NOT NULL AS gone FROM lk LEFT JOIN bad b ON lk.host = b.host AND lk.k = b.k AND lk.n > 0),
c AS (SELECT doc_id, sum(n) FILTER (WHERE gone) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS left_ FROM t GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
coalesce(dup.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256 FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed > 0 AND (n_words - n_removed < 10 OR n_words - n_removed < 0.7::DOUBLE * n_words)) AS kept FROM m"""

OP9 = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, {_KEY} AS k FROM l),
f AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
t AS (SELECT k.doc_id, i, line, f.k IS NOT NULL AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM t GROUP BY doc_id"""

#: The base patterns as the contract writes them; this engine has no need of possessive repeats.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse({_DIGITS})[j] AS INTEGER) ELSE CAST(reverse({_DIGITS})[j] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[j] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_FOLDED = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: ascii(c))), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
_CHECKS = {
    "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: TRY_CAST(ltrim(x, '0') AS INTEGER) > 255 OR length(ltrim(x, '0')) > 3)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 10 AND 15", "iban": _FOLDED,
    "ssn": "NOT regexp_matches(right(g, 1), '[0-9-]') AND NOT regexp_matches(left(a, 1), '[0-9-]')",
}


def _pii() -> str:
    parts = []
    for rank, (kind, _, _, own, words) in enumerate(pii.KINDS):
        p = _PATTERNS[kind]
        near = f"regexp_matches(lower(right(g, {pii.REACH}) || ' ' || left(a, {pii.REACH})), '{pii.whole_words(words)}')"
        score = f"{own}::DOUBLE + CASE WHEN {near} THEN {pii.CONTEXT}::DOUBLE ELSE 0 END"
        ok = _CHECKS[kind] + ("" if kind in pii.BASE else f" AND {score} >= 0.5::DOUBLE")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, before + length(g) AS s, before + length(g) + length(m) AS e, {score} AS score FROM (
SELECT doc_id, m[i] AS m, g[i] AS g, g[i + 1] AS a, coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]) + length(g[j]))), 0)::BIGINT AS before FROM (
SELECT doc_id, m, string_split_regex(text, '{p}') AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{p}') AS m FROM documents))) WHERE {ok}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in (*pii.BASE, "iban", "ssn"))
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""WITH f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts}, {joined} FILTER (WHERE rank < {len(pii.BASE)}) AS b, {joined} AS spans, max(score) AS max_score FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in (*pii.BASE, 'iban', 'ssn'))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(max_score, 0) AS max_score FROM documents LEFT JOIN g USING (doc_id)"""


def _warc() -> str:
    bare = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = "regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(b, '^([^/?]*)', 1), '^.*@', '')), ':(80|443)$', ''), '^www[0-9]*\\.', '')"
    path = "regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = f"array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{warc.TRACKING}'))), '&')"
    line = lambda name, value: f"'{name}: ' || {value}"
    hot = [url.replace("'", "''") for url in warc.HOT]
    other = "'HTTP://me@WWW.' || upper(regexp_extract(bare, '^[a-z]+://([^/?]*)(.*)$', 1)) || ':80' || regexp_extract(bare, '^[a-z]+://([^/?]*)(.*)$', 2) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail&gclid=' || n"
    return f"""WITH p AS (SELECT page_id AS n, url, regexp_replace(url, '#.*$', '') AS bare, md5(coalesce(html, '')) AS md5, length(html) AS size, page_id * 7919 % 2592000 AS begun,
CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 29) END AS day1, CASE WHEN page_id % 4 <> 0 THEN 'day ' || (page_id % 31) END AS day2,
CASE WHEN page_id % 5 <> 0 THEN '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' END AS tag1, CASE WHEN page_id % 5 <> 0 THEN '"' || substr(md5(coalesce(html, '')), 17, 16) || '"' END AS tag2 FROM pages),
rec AS (SELECT n * 4 AS id, n, 0 AS kind, url, begun AS t, tag1 AS tag, day1 AS modified, md5, size FROM p
UNION ALL SELECT n * 4 + 1, n, 1, CASE WHEN n % 3 = 0 THEN '{hot[0]}' ELSE {other} END, CASE WHEN n % 6 = 1 THEN begun ELSE begun + 700000 + n % 500000 END, tag2, day2, md5(md5), size + 1 FROM p
UNION ALL SELECT n * 4 + 2, n, 2, url, begun + 3600 + n * 104729 % 2000000, CASE WHEN n % 7 = 0 THEN '"other"' ELSE 'W/' || CASE WHEN n % 2 = 0 THEN tag2 ELSE tag1 END END, CASE WHEN n % 2 = 0 THEN day2 ELSE day1 END, NULL, NULL FROM p
UNION ALL SELECT n * 4 + 3, n, 3, CASE WHEN n % 3 = 0 THEN '{hot[1]}' ELSE url END, begun - 50000 + n * 31 % 900000, NULL, day1, md5, NULL FROM p),
c AS (SELECT *, {host} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END AS canon FROM (SELECT *, {bare} AS b FROM rec)),
full_ AS (SELECT * FROM c WHERE kind < 2), rev AS (SELECT * FROM c WHERE kind > 1),
one AS (SELECT canon, t, max(id) AS id FROM full_ GROUP BY canon, t),
j AS (SELECT r.*, o.id AS f FROM rev r ASOF LEFT JOIN one o ON r.canon = o.canon AND r.t > o.t),
m AS (SELECT j.*, x.tag AS ftag, x.modified AS fmodified, x.md5 AS fmd5, x.size AS fsize, coalesce(regexp_replace(j.tag, '^W/', '') = x.tag, j.modified = x.modified, j.md5 = x.md5) AS ok FROM j LEFT JOIN full_ x ON x.id = j.f),
s AS (SELECT *, CASE WHEN f IS NULL THEN 'no_response' WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'not_modified' ELSE 'validator_mismatch' END AS status FROM m)
SELECT id AS record_id, canon AS canonical_url, f AS refers_to, status, CASE WHEN status IN ('not_modified', 'unverified') THEN array_to_string(list_filter([
CASE WHEN kind = 2 THEN 'age: 1' END, {line('cache-control', "'max-age=' || CASE WHEN kind = 2 THEN n % 100 ELSE 60 END")}, {line('content-length', 'fsize')}, 'content-type: text/html',
CASE WHEN kind = 3 THEN 'date: later' END, {line('etag', 'coalesce(tag, ftag)')}, {line('last-modified', 'coalesce(modified, fmodified)')}], lambda v: v IS NOT NULL), chr(10)) END AS headers FROM s"""


def _lloyd(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    """Plain Lloyd rounds: every vector against every centroid each time."""
    far = "list_sum(list_transform(range(1, {d}), lambda i: (v.q[i] - c.c[i]) * (v.q[i] - c.c[i])))::BIGINT".format(d=dim + 1)
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS n, q AS c FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v) ORDER BY h NULLS LAST, q LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min((d, n))[1] AS d, min((d, n))[2] AS n FROM (SELECT v.r, c.n, {far} AS d FROM v CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT n, i, sum(q[i])::BIGINT AS s, count(*) AS m FROM (SELECT a.n, v.q, unnest(range(1, {dim + 1})) AS i FROM a{i} a JOIN v USING (r)) GROUP BY n, i),
c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(x.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{i} GROUP BY n) x USING (n))""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(a.n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.n = a.n"""


#: The CRC-32 table (polynomial EDB88320) and the checksum of a text's UTF-8 bytes.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(i)))"


def _crc(text: str, table: str = "crc.t") -> str:
    byte = f"list_transform(range(1, 1 + length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1])), 4294967295)"


def _language(sample: int = 4000, words: int = 100_000, grams: int = 200_000) -> str:
    top = "QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) <= {most} // (SELECT count(*) FROM p)"
    log = "CAST(round(1000 * ln((coalesce(n, 0) + 0.5::DOUBLE) / (a + v / 2::DOUBLE))) AS BIGINT)"
    return f"""WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w, coalesce({_crc('doc_id::VARCHAR')} % 4 = 2, false) AS held_out FROM documents, crc),
t AS MATERIALIZED (SELECT lang, w FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), text) <= {sample}),
p AS (SELECT lang, CAST(round(1000 * ln(count(*) / (SELECT count(*) FROM t)::DOUBLE)) AS BIGINT) AS s FROM t GROUP BY lang),
wc AS MATERIALIZED (SELECT lang, g, count(*) AS n FROM (SELECT lang, unnest(w) AS g FROM t) GROUP BY ALL),
gc AS MATERIALIZED (SELECT lang, z, g, sum(n) AS n FROM (SELECT lang, z, n, unnest(list_transform(range(1, length(g) + 4 - z), lambda i: substr(' ' || g || ' ', i, z))) AS g FROM wc, range(1, 6) x(z)) WHERE g <> ' ' GROUP BY ALL),
kw AS MATERIALIZED (SELECT DISTINCT g FROM (SELECT lang, g, n FROM wc {top.format(most=words)})),
kg AS MATERIALIZED (SELECT DISTINCT z, g FROM (SELECT lang, z, g, n FROM gc QUALIFY row_number() OVER (PARTITION BY lang, z ORDER BY n DESC, g) <= {grams // 5} // (SELECT count(*) FROM p))),
wn AS MATERIALIZED (SELECT kw.g, p.lang, n FROM kw CROSS JOIN p LEFT JOIN wc ON wc.g = kw.g AND wc.lang = p.lang),
gn AS MATERIALIZED (SELECT kg.z, kg.g, p.lang, n FROM kg CROSS JOIN p LEFT JOIN gc ON gc.g = kg.g AND gc.z = kg.z AND gc.lang = p.lang),
wl AS MATERIALIZED (SELECT g, lang, {log} AS s FROM wn JOIN (SELECT lang, coalesce(sum(n), 0) AS a, count(*) AS v FROM wn GROUP BY lang) USING (lang)),
gl AS MATERIALIZED (SELECT z, g, lang, {log} AS s FROM gn JOIN (SELECT z, lang, coalesce(sum(n), 0) AS a, count(*) AS v FROM gn GROUP BY z, lang) USING (z, lang)),
x AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS g FROM d) GROUP BY ALL),
u AS (SELECT DISTINCT g FROM x ANTI JOIN kw USING (g)),
b AS (SELECT g AS word, z, unnest(list_transform(range(1, length(g) + 4 - z), lambda i: substr(' ' || g || ' ', i, z))) AS g FROM u, range(1, 6) y(z)),
bs AS MATERIALIZED (SELECT word AS g, lang, z, CAST(floor(sum(s) / count(*)::DOUBLE) AS BIGINT) AS s FROM b JOIN gl USING (z, g) GROUP BY word, lang, z QUALIFY z = max(z) OVER (PARTITION BY word)),
a AS MATERIALIZED (SELECT g, lang, s FROM wl UNION ALL SELECT g, lang, s FROM bs),
tot AS MATERIALIZED (SELECT doc_id, lang, sum(x.n * s) AS s, sum(x.n) AS n FROM x JOIN a USING (g) GROUP BY ALL),
f AS (SELECT d.doc_id, p.lang, p.s + coalesce(tot.s, 0) AS s, coalesce(tot.n, 0) AS n FROM d CROSS JOIN p LEFT JOIN tot ON tot.doc_id = d.doc_id AND tot.lang = p.lang WHERE len(d.w) > 0),
m AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM f),
r AS (SELECT doc_id, min(lang) FILTER (WHERE s = best) AS lang, round(1 / sum(exp((s - best)::DOUBLE / (1000 * greatest(1, sqrt(n))))), 6) AS score FROM m GROUP BY doc_id)
SELECT doc_id, held_out, coalesce(r.lang, 'und') AS lang_pred, coalesce(score, 0::DOUBLE) AS score FROM d LEFT JOIN r USING (doc_id)"""


def _spelling() -> str:
    cut = "substr({w}, 1, {i}) || substr({w}, {i} + 2)"
    return f"""WITH RECURSIVE {_CRC_TABLE},
r AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT w, n, {_crc("doc_id || ':' || w")} AS h FROM r, crc),
t AS (SELECT CASE WHEN h % 97 = 0 THEN {cut.format(w='w', i='CAST(h % length(w) AS BIGINT)')} ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY w HAVING length(w) >= 5 AND sum(n) >= 3),
c AS MATERIALIZED (SELECT w, i, {cut.format(w='w', i='i')} AS s FROM (SELECT w, unnest(range(length(w))) AS i FROM v)),
e AS MATERIALIZED (SELECT a.w AS a, b.w AS b FROM c a JOIN c b ON a.s = b.s AND a.i = b.i AND a.w <> b.w UNION SELECT c.w, v.w FROM c JOIN v ON c.s = v.w UNION SELECT v.w, c.w FROM c JOIN v ON c.s = v.w),
b AS (SELECT e.a AS w, count(*) AS n_near, max(v.n) AS most, arg_min(e.b, (-v.n, e.b)) AS best FROM e JOIN v ON v.w = e.b GROUP BY e.a),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN best END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN b USING (w)),
g AS (SELECT w, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT g.w, f.form FROM g JOIN f ON f.w = g.at WHERE f.form IS NOT NULL),
o AS (SELECT g.w, g.at FROM g JOIN f ON f.w = g.at WHERE f.form IS NULL)
SELECT f.w AS word, form, coalesce(o.at, f.w) AS root, n, n_near, form_n FROM f LEFT JOIN o USING (w)"""


ORACLES: dict[str, str] = {
    "op1_warc_revisits": _warc(), "op2_superminhash_dedup": OP2, "op3_pii": _pii(), "op5_winnowing_decontamination": OP5, "op6_recurring_passages": OP6,
    "op7_reply_trees": OP7, "op8_quality_rules": OP8, "op9_line_dedup": OP9,
    "op11_delta_lloyd": _lloyd(), "op12_language_id": _language(), "op13_spelling_variants": _spelling(),
}
