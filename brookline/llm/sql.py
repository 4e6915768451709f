"""SQL that says the same as a query, for the operators that plain SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d)),
o AS (SELECT h, min(doc_id) AS owner FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT w.doc_id, unnest(range(p, p + 50)) AS q FROM w JOIN o USING (h) WHERE owner < w.doc_id)),
each AS (SELECT doc_id, q, ws[q] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM each ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
link AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT link.v, r.c FROM r JOIN link ON link.u = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: What the rules of op4_url_filters say; verdicts of URLs that no rule fits are the trees'.
URL_RULES = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, coalesce(host, ''), coalesce(path, ''), f.rule, f.verdict FROM h LEFT JOIN f ON f.page_id = h.page_id
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN substr(reverse({_DIGITS}), i, 1)::INT * 2 - 9 ELSE substr(reverse({_DIGITS}), i, 1)::INT * 2 END)) % 10 = 0"

#: The counts of base spans of op3_pii.
PII_COUNTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS cards, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phones FROM d)
SELECT doc_id, n_email, len(list_filter(ips, lambda m: len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0)),
  len(list_filter(cards, lambda m: length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN})), len(list_filter(phones, lambda m: length({_DIGITS}) BETWEEN 8 AND 15)) FROM e
"""
