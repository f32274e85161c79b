"""Queries of problems 1 to 10, with production parameters over whole tables, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from postmill.llm import copies, encoding, group_split, leakage, lookalike, near_dup, newtext, packing, personal, quality

QUERIES = {
    "p1_found": newtext.p1_found,
    "p2_found": near_dup.p2_found,
    "p3_found": lookalike.p3_found,
    "p3_forms": lookalike.p3_forms,
    "p4_found": group_split.p4_found,
    "p4_split": group_split.p4_split,
    "p4_authors": group_split.p4_authors,
    "p5_found": personal.p5_found,
    "p5_masked": personal.p5_masked,
    "p6_found": copies.p6_found,
    "p6_messages": copies.p6_messages,
    "p7_found": encoding.p7_found,
    "p7_restored": encoding.p7_restored,
    "p8_packed": packing.p8_packed,
    "p8_fill": packing.p8_fill,
    "p9_found": leakage.p9_found,
    "p10_found": quality.p10_found,
    "p10_stats": quality.p10_stats,
}

_BLANK = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_GRAMS = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"
_LETTERS = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_COPIES = (
    "WITH RECURSIVE f AS (SELECT msg_id, domain, " + _LETTERS.format("text") + " AS plain, list_filter(string_split_regex(text, '[\\n\\r;|]'), lambda x: regexp_matches(x, '[^\\s\\x{0b}]')) AS ps FROM corpus), "
    "k AS (SELECT msg_id, domain, plain, CASE WHEN len(ps) >= 3 AND len(list_filter(ps, lambda x: NOT regexp_full_match(x, '[\\s\\x{0b}]*\\p{Latin}[\\p{Latin} ]*[:=][\\s\\x{0b}]*[^\\s\\x{0b}].*'))) = 0 "
    "THEN array_to_string(list_sort(list_transform(ps, lambda x: " + _LETTERS.format("x") + ")), chr(1)) END AS fields FROM f), "
    "e AS (SELECT DISTINCT domain, plain, fields FROM k WHERE fields IS NOT NULL), "
    "r(domain, plain, root) AS (SELECT domain, plain, plain FROM k UNION SELECT r.domain, b.plain, r.root FROM r JOIN e a ON a.domain = r.domain AND a.plain = r.plain JOIN e b ON b.domain = a.domain AND b.fields = a.fields), "
    "g AS (SELECT domain, plain, min(root) AS root FROM r GROUP BY ALL), m AS (SELECT k.msg_id, k.domain, min(k.msg_id) OVER (PARTITION BY k.domain, g.root) AS keep_id, count(*) OVER (PARTITION BY k.domain, g.root) AS copies FROM k JOIN g ON g.domain = k.domain AND g.plain = k.plain) "
)

_SPLIT = (
    "WITH RECURSIVE k AS (SELECT msg_id, coalesce('g' || \"group\", 'm' || msg_id) AS k, text, coalesce(lower(trim(domain)), '-') || '/' || coalesce(lower(trim(label)), '-') AS stratum FROM corpus), "
    "n AS (SELECT k, min(msg_id) AS least FROM k GROUP BY k), e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b ON a.text = b.text AND a.k <> b.k), "
    "r(k, root) AS (SELECT k, least FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k), c AS (SELECT k, min(root) AS component FROM r GROUP BY k), p AS (SELECT msg_id, component, stratum FROM k JOIN c USING (k)), "
    "s AS (SELECT component, stratum, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT component, sum(n)::bigint AS rows, arg_max(stratum, (n, stratum)) AS stratum FROM s GROUP BY component), "
    f"d AS (SELECT *, length(bin(rows)) AS size, floor(('0x' || substr(md5('42:' || component), 1, 8))::bigint / 4294967296.0 * {group_split.BUCKETS})::int AS bucket FROM w), "
    "g AS (SELECT stratum, size, bucket, sum(rows) AS rows FROM d GROUP BY ALL), "
    "m AS (SELECT *, (sum(rows) OVER (PARTITION BY stratum, size ORDER BY bucket) - rows / 2) / sum(rows) OVER (PARTITION BY stratum, size) AS middle FROM g) "
)

ORACLES: dict[str, str] = {
    "p2_found": (
        f"WITH RECURSIVE n AS (SELECT msg_id, domain, regexp_replace(regexp_replace(lower(text), '\\p{{Nd}}', '0', 'g'), '{_BLANK}', ' ', 'g') AS t FROM corpus), "
        "u AS (SELECT domain, t, min(msg_id) AS id FROM n GROUP BY ALL), "
        "s AS (SELECT id, domain, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: t[i:i + 4]))) AS g FROM u), z AS (SELECT id, count(*) AS c FROM s GROUP BY id), "
        "d AS (SELECT domain, g, count(*) AS df FROM s GROUP BY ALL), p AS (SELECT s.id, s.domain, s.g, z.c, row_number() OVER (PARTITION BY s.id ORDER BY d.df, s.g) AS r FROM s JOIN z USING (id) JOIN d USING (domain, g)), "
        "x AS (SELECT id, domain, g, c FROM p WHERE r <= c - ceil(0.7 * c - 1e-9) + 1), cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.domain = b.domain AND a.g = b.g AND a.id < b.id AND least(a.c, b.c) >= 0.7 * greatest(a.c, b.c) - 1e-9), "
        "o AS (SELECT cand.a, cand.b, count(*) AS i FROM cand JOIN s sa ON sa.id = cand.a JOIN s sb ON sb.id = cand.b AND sb.g = sa.g GROUP BY ALL), "
        "e AS (SELECT a, b FROM o JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE i >= 0.7 * (za.c + zb.c - i) - 1e-9), b2 AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), "
        "r(x, root) AS (SELECT id, id FROM u UNION SELECT b2.y, r.root FROM r JOIN b2 ON b2.x = r.x AND r.root < b2.y), m AS (SELECT x, min(root) AS root FROM r GROUP BY x) "
        "SELECT m.root AS first_id, n.msg_id FROM n JOIN u USING (domain, t) JOIN m ON m.x = u.id WHERE n.msg_id <> m.root"
    ),
    "p4_found": "SELECT \"group\" AS group_id FROM (SELECT \"group\", lower(trim(split, E' \\t\\n\\r')) AS s FROM corpus WHERE \"group\" IS NOT NULL) WHERE s IN ('train', 'val', 'test') GROUP BY 1 HAVING count(DISTINCT s) > 1",
    "p4_split": _SPLIT + "SELECT p.msg_id, p.component, CASE WHEN middle < 0.7 - 1e-12 THEN 'train' WHEN middle < 0.85 - 1e-12 THEN 'val' ELSE 'test' END AS split FROM p JOIN d USING (component) JOIN m ON m.stratum = d.stratum AND m.size = d.size AND m.bucket = d.bucket",
    "p6_found": _COPIES + "SELECT keep_id, msg_id FROM m WHERE msg_id <> keep_id",
    "p6_messages": _COPIES + "SELECT DISTINCT keep_id, domain, copies FROM m",
    "p9_found": f"WITH d AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), p AS (SELECT DISTINCT probe_id, unnest({_GRAMS}) AS g FROM (SELECT probe_id, {_WORDS} AS w FROM probes)) SELECT DISTINCT doc_id, probe_id FROM d JOIN p USING (g)",
}
