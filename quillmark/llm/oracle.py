"""DuckDB SQL of the operators whose results SQL can express."""

from __future__ import annotations

from . import secret_scan
from .quality_rules import REACH, RULES

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_LEVEL = """
b{n} AS (SELECT s.k, s.rest, s.below, substr(d.h, 1, {digits}) AS bucket, sum(d.size) AS su FROM s{p} s JOIN d ON d.k = s.k AND starts_with(d.h, s.edge) WHERE s.rest > 0 GROUP BY ALL),
c{n} AS (SELECT *, below + sum(su) OVER (PARTITION BY k ORDER BY bucket) AS upto FROM b{n}),
e{n} AS (SELECT k, min_by(bucket, bucket) AS edge, min_by(upto - su, bucket) AS below, min_by(upto - rest < rest - upto + su, bucket) AS take FROM c{n} WHERE upto > rest GROUP BY k),
s{n} AS (SELECT s.k, s.size, s.target, s.epochs, s.rest, coalesce(e.edge, '') AS edge, coalesce(e.below, 0) AS below, coalesce(e.take, false) AS take FROM s{p} s LEFT JOIN e{n} e USING (k)),"""

OP1 = (
    rf"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS k, len({WORDS.format("text")}) AS size, substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9) AS h FROM documents),
sums AS (SELECT k, source, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM sums),
l AS (SELECT *, size::DOUBLE / w AS room, 3 * sum(size) OVER () - 4 * coalesce(sum(size) OVER o, 0) AS lft, 2 * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS parts FROM w WINDOW o AS (ORDER BY size::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, size * 2 * parts <= w * lft AS capped FROM l),
u AS (SELECT min(struct_pack(room := room, k := k, lft := lft, parts := parts)) AS lv FROM m WHERE NOT capped),
t AS (SELECT k, size, CASE WHEN capped THEN (2 * size)::DOUBLE ELSE (w * lv.lft)::DOUBLE / lv.parts::DOUBLE END AS target FROM m LEFT JOIN u ON true),
g AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END::BIGINT AS epochs FROM t),
s0 AS (SELECT *, target - epochs * size AS rest, '' AS edge, 0 AS below, false AS take FROM g),"""
    + "".join(_LEVEL.format(n=n, p=n - 1, digits=3 * n) for n in (1, 2, 3))
    + """
z AS (SELECT 1)
SELECT d.doc_id, d.source, d.size::BIGINT AS size, s.size AS source_size, s.target, (d.size * (s.epochs + CASE WHEN d.h < s.edge OR s.take AND d.h = s.edge THEN 1 ELSE 0 END))::BIGINT AS taken FROM d JOIN s3 s USING (k)
"""
)


def _rules() -> str:
    names = list(RULES)
    ratio = {r: f"floor({top} * {scale} / greatest({under}, 1))::BIGINT" for r, (top, under, scale, *_) in RULES.items()}
    sets = " UNION ALL ".join(f"SELECT l, s, '{r}' AS rule, x_{r} AS v FROM v WHERE NOT base_failed" for r in names)
    inside = " AND ".join(f"coalesce(x_{r} >= f_{r}.lo, true) AND coalesce(x_{r} <= f_{r}.hi, true)" for r in names)
    entry = lambda place: "CASE rule " + " ".join(f"WHEN '{r}' THEN {rule[place]}" for r, rule in RULES.items()) + " END"
    percent, floor = entry(3), entry(4)
    low = "rule IN (" + ", ".join(f"'{r}'" for r, rule in RULES.items() if rule[5]) + ")"
    picks = ", ".join(f"max(CASE WHEN g.rule = '{r}' THEN coalesce(f0.f, f1.f, f3.f) END) AS f_{r}" for r in names)
    return rf"""
WITH a AS (SELECT doc_id, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s, coalesce(text, '') AS text, {WORDS.format("text")} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
gr AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM a WHERE len(words) >= 3)),
tw AS (SELECT doc_id, i FROM gr QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rp AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tw, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, l, s, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z!]', '', 'g')))::BIGINT AS n_shout, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM a LEFT JOIN rp USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{e} AS x_{r}" for r, e in ratio.items())} FROM m),
flat AS ({sets}),
b AS (SELECT l, s, rule, (v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT AS bucket FROM flat),
sk AS (SELECT 0 AS lv, l, s, rule, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, l, NULL, rule, bucket, count(*) FROM b GROUP BY ALL UNION ALL SELECT 3, NULL, NULL, rule, bucket, count(*) FROM b GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY lv, l, s, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lv, l, s, rule) AS al FROM sk),
q AS (SELECT lv, l, s, rule, max(al) AS al, min(CASE WHEN upto * 100 >= al * (100 - {percent}) THEN bucket END) AS lo, min(CASE WHEN upto * 100 >= al * 50 THEN bucket END) AS mid, min(CASE WHEN upto * 100 >= al * {percent} THEN bucket END) AS hi FROM rk GROUP BY ALL HAVING max(al) >= 30 OR lv = 3),
f AS (SELECT lv, l, s, rule, struct_pack(lo := CASE WHEN {low} THEN lo - greatest({REACH} * (mid - lo), {floor}) END, hi := hi + greatest({REACH} * (hi - mid), {floor})) AS f FROM q),
g AS (SELECT DISTINCT l, s, rule FROM flat),
lim AS (SELECT g.l, g.s, {picks} FROM g LEFT JOIN f f0 ON f0.lv = 0 AND f0.l = g.l AND f0.s = g.s AND f0.rule = g.rule LEFT JOIN f f1 ON f1.lv = 1 AND f1.l = g.l AND f1.rule = g.rule LEFT JOIN f f3 ON f3.lv = 3 AND f3.rule = g.rule GROUP BY g.l, g.s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept, n_shout, n_lines FROM v LEFT JOIN lim USING (l, s)
"""


_TOKENS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS words FROM documents),
i AS (SELECT item_id::VARCHAR AS item, words, least(10, len(words)) AS n FROM (SELECT item_id, {_TOKENS.format("text")} AS words FROM benchmark) WHERE len(words) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(words[j : j + n - 1], ' ') AS win FROM (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS j FROM i)),
lengths AS (SELECT DISTINCT n FROM i),
dw AS (SELECT doc_id, n, j, array_to_string(words[j : j + n - 1], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS j FROM d, lengths WHERE len(words) >= n)),
h AS (SELECT doc_id, j, n, item FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
w AS (SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS p, CASE WHEN i > 2 THEN words[i - 2] END AS pp FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
c AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY w) - 1 AS c1, CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY p, w) - 1 ELSE 0 END AS c2, CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY pp, p, w) - 1 ELSE 0 END AS c3 FROM w),
x AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM c),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS l, least(i, 3) AS m, CASE WHEN c3 > 0 THEN c3 / h2 WHEN c2 > 0 THEN c2 / h1 WHEN c1 > 0 THEN c1 / n ELSE 0.4::DOUBLE / n END AS r FROM x),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (l = 0) AS l0, count(*) FILTER (l = 1) AS l1, count(*) FILTER (l = 2) AS l2, count(*) FILTER (l = 3) AS l3, sum(ln(r) + ln(0.4::DOUBLE) * (m - greatest(l, 1))) AS s FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(l0, 0) AS n_level0, coalesce(l1, 0) AS n_level1, coalesce(l2, 0) AS n_level2, coalesce(l3, 0) AS n_level3, round(coalesce(s, 0), 6) AS log_score FROM d LEFT JOIN t USING (doc_id)
"""

# Base 32 of a SHA-1: eight characters for each five bytes, here from its hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (bits[5 * i + 1 : 5 * i + 5]::BIT)::INT, 1)), '')"

OP3 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT page_id, coalesce(url, '') AS url, strlen(html)::BIGINT AS n, array_to_string(list_transform(string_split(sha, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits, min(page_id) OVER (PARTITION BY html) AS one FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> one THEN one END AS refers_to, url FROM q
"""

def _secrets() -> str:
    """Windows are counted anew here, each by itself."""
    kinds = [(i, kind, pattern, group, least) for i, (kind, (pattern, group, least)) in enumerate(secret_scan.BASE.items())] + [(3, secret_scan.ENTROPY, secret_scan.CANDIDATE, 0, secret_scan.LEAST)]
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    cut = " UNION ALL ".join(f"SELECT r, {i} AS no, '{kind}' AS kind, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS found FROM d WHERE regexp_matches(t, {quoted(p)})" for i, kind, p, _, _ in kinds)
    long = " OR ".join(f"no = {i} AND length(regexp_extract(m, {quoted(p)}, {group})) >= {least}" for i, _, p, group, least in kinds[:3])
    known = " OR ".join([f"NOT regexp_matches(m, {quoted(secret_scan.PUT_TOGETHER)})", *(f"regexp_matches(m, {quoted(p)})" for p in secret_scan.ALLOWED)])
    w, most = secret_scan.WINDOW, secret_scan.MOST
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS ({cut}),
m AS (SELECT r, no, kind, i, found[i] AS m, length(gaps[i]) AS gap FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM c)),
p AS (SELECT r, no, kind, m, sum(gap + length(m)) OVER (PARTITION BY r, no ORDER BY i) - length(m) AS a FROM m),
b AS (SELECT r, no, kind, a::BIGINT AS a, (a + length(m))::BIGINT AS e FROM p WHERE {long}),
k AS (SELECT r, a, m, row_number() OVER () AS nth FROM p WHERE no = 3 AND NOT ({known})),
s AS (SELECT nth, r, a, j, substr(m, j + 1, {w}) AS x FROM (SELECT *, unnest(range(0, length(m) - {w - 1})) AS j FROM k)),
u AS (SELECT *, list_sum(list_transform(list_distinct(string_split(x, '')), lambda y: {secret_scan.TERMS}[1 + length(x) - length(replace(x, y, ''))])) AS h, regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]') AS two FROM s),
hit AS (SELECT * FROM u WHERE h <= CASE WHEN two AND regexp_full_match(x, '[0-9A-Fa-f]+') THEN {most["hexadecimal"]} WHEN two THEN {most["mixed"]} WHEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') THEN {most["letters"]} ELSE -1 END),
isle AS (SELECT *, sum(new) OVER (PARTITION BY nth ORDER BY j) AS isle FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY nth ORDER BY j) <= {w} THEN 0 ELSE 1 END AS new FROM hit)),
e AS (SELECT r, 3 AS no, '{secret_scan.ENTROPY}' AS kind, (any_value(a) + min(j))::BIGINT AS a, (any_value(a) + max(j) + {w})::BIGINT AS e FROM isle GROUP BY r, nth, isle),
al AS (SELECT *, kind || ':' || a || ':' || e AS told FROM (FROM b UNION ALL FROM e)),
g AS (SELECT r, count(*) FILTER (no = 0) AS n0, count(*) FILTER (no = 1) AS n1, count(*) FILTER (no = 2) AS n2, string_agg(told, ',' ORDER BY a, no) FILTER (no < 3) AS base, string_agg(told, ',' ORDER BY a, no) AS spans FROM al GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(words) AS t FROM d),
k AS (SELECT lang, t, count(*) AS n FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN k USING (lang, t) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
t AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM b UNION ALL FROM t) QUALIFY part = 'pair' OR rank <= 200
"""

SQL = {"op3_warc_index": OP3, "op9_stupid_backoff": OP9, "op1_mix_sources": OP1, "op2_quality_rules": _rules(), "op10_decontaminate": OP10, "op11_secret_scan": _secrets(), "op13_source_divergence": OP13}
