"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES, needed, word_list
from .url_filter import RULES, SUFFIXES

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def url_filters(z: float = 2.0, least_good: float = 0.5) -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    suffixes = ", ".join(f"'{x}'" for x in SUFFIXES)
    # The upper bound of a host without labels: the prior that the nearest known level gives.
    prior = lambda k, mean: f"round({mean} + {z} * sqrt({mean} * (1 - {mean}) / ({k} + 1)), 6)"
    level = """
{name}_ AS (SELECT c.*, a.above FROM {counts} c JOIN {above} a ON {on}),
{name}_k AS (SELECT greatest(2.0, least(200.0, coalesce(CASE WHEN spread > noise THEN round((size * noise / units - spread) / (spread - noise), 3) ELSE 200.0 END, 200.0))) AS k
  FROM (SELECT sum(above * (1 - above)) AS noise, sum(n * (g / n - above) * (g / n - above)) AS spread, sum(n) AS size, count(*) AS units FROM {name}_)),
{name}_p AS (SELECT x.*, k * above + g AS a, k * (1 - above) + n - g AS b, (k * above + g) / (k * above + g + k * (1 - above) + n - g) AS mean FROM {name}_ x, {name}_k)"""
    return f"""
WITH rules(verdict, rh, rp) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
raw AS (SELECT page_id, regexp_extract(r, '(?s)^([^/?#]*)', 1) AS h, r FROM rest),
urls AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(r, length(h) + 1), '(?s)^([^?#]*)', 1) AS path FROM raw),
good AS (SELECT host, CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM urls JOIN labels ON doc_id = page_id WHERE host <> ''),
named AS (SELECT host, array_to_string(list_slice(labels, -1 - depth, -1), '.') AS domain, array_to_string(list_slice(labels, -depth, -1), '.') AS suffix
  FROM (SELECT host, labels, CASE WHEN array_to_string(list_slice(labels, -2, -1), '.') IN ({suffixes}) THEN 2 ELSE 1 END AS depth FROM (SELECT DISTINCT host, string_split(host, '.') AS labels FROM urls))),
hosts AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS g FROM good JOIN named USING (host) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(g) + 1) / (sum(n) + 2) ELSE 0.5 END AS above FROM hosts),
{level.format(name="s", counts="suffixes", above="overall", on="true").strip()},
{level.format(name="d", counts="domains", above="(SELECT suffix, mean AS above FROM s_p)", on="a.suffix = c.suffix").strip()},
{level.format(name="h", counts="hosts", above="(SELECT domain, mean AS above FROM d_p)", on="a.domain = c.domain").strip()},
reputation AS (SELECT host, round(mean + {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS upper FROM h_p),
priors AS (SELECT named.host, coalesce({prior("h_k.k", "d_p.mean")}, {prior("d_k.k", "s_p.mean")}, {prior("s_k.k", "o.mean")}) AS upper FROM named LEFT JOIN d_p USING (domain) LEFT JOIN s_p ON s_p.suffix = named.suffix
  LEFT JOIN (SELECT above AS mean FROM overall WHERE EXISTS (SELECT 1 FROM hosts)) o ON true, h_k, d_k, s_k WHERE named.host <> ''),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM urls, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN coalesce(r.upper, p.upper) < {least_good} THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN fits f USING (page_id) LEFT JOIN reputation r ON r.host = u.host LEFT JOIN priors p ON p.host = u.host
"""


def license_scans(threshold: float = 0.8) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    parts, places = [], []
    for phrase, label in PHRASES:
        p = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
        places.append(f"list_filter(range(len(w) - {len(p) - 1}), lambda i: {same})")
        parts.append(f"CASE WHEN len({places[-1]}) > 0 THEN ['{label}'] ELSE []::VARCHAR[] END")
    rows = [(label, *needed(word_list(text), threshold)) for label, text in TEMPLATES]
    templates = ", ".join(f"({k}, '{label}', {t}, {need}, {length})" for k, (label, t, need, length) in enumerate(rows))
    return rf"""
WITH templates(k, label, t, need, length) AS (VALUES {templates}),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{word}') AS w FROM d),
base AS (SELECT doc_id, len(w) AS n_words, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS spots, list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]}) AS labels FROM w),
hits AS (SELECT doc_id, k, word, pos FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w) JOIN (SELECT k, unnest(t) AS word FROM templates) USING (word)),
likely AS (SELECT doc_id, k, label, length, need, len(t) AS size FROM (SELECT doc_id, k, count(DISTINCT word) AS n FROM hits GROUP BY ALL) JOIN templates USING (k) WHERE n >= need),
blocks AS (SELECT a.doc_id, a.k, a.pos, any_value(label) AS label, any_value(need) AS need, any_value(size) AS size, count(DISTINCT b.word) AS n FROM likely JOIN hits a USING (doc_id, k) JOIN hits b ON b.doc_id = a.doc_id AND b.k = a.k AND b.pos BETWEEN a.pos AND a.pos + length - 1 GROUP BY a.doc_id, a.k, a.pos),
found AS (SELECT doc_id, label, n / size::DOUBLE AS c FROM blocks WHERE n >= need),
best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM found GROUP BY doc_id)
SELECT doc_id, n_words, len(spots) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word, array_to_string(list_sort(base.labels), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(best.labels, []::VARCHAR[])))), ',') AS labels, CASE WHEN len(base.labels) > 0 THEN 1.0::DOUBLE ELSE coalesce(round(c, 6), 0)::DOUBLE END AS score
FROM base LEFT JOIN best USING (doc_id)
"""


#: Every order applied to the counts of every mask; the Shapley sums are taken over the orders themselves.
FILTER_AUDIT = r"""
WITH RECURSIVE letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, step, f, bit, before) AS (
  SELECT f, 1, f, bit, 0 FROM letters
  UNION ALL SELECT o.filter_order || l.f, o.step + 1, l.f, l.bit, o.before + o.bit FROM orders o JOIN letters l ON NOT contains(o.filter_order, l.f)),
whole AS (SELECT w.filter_order, p.step, p.f, p.bit, p.before FROM orders w JOIN orders p ON starts_with(w.filter_order, p.filter_order) WHERE w.step = 5),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
copies AS (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy FROM texts),
masks AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask FROM copies),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY ALL),
steps AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, whole GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps
"""

#: Every document that holds a term of an item is scored for it.
LEXICAL_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS n_row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, term, count(*) AS asked FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
sizes AS (SELECT n_row, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS (SELECT n_row, term, count(*)::BIGINT AS tf FROM (SELECT n_row, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term),
norms AS (SELECT n_row, doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM sizes, totals),
scores AS (SELECT item_id, n_row, doc_id, sum(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (n_row) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
