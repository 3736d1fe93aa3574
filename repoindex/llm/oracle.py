"""DuckDB SQL for the queries that SQL can state."""

ASCII_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS.format(ASCII_LOWER.format('text'))} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(ASCII_LOWER.format('text'))} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN win USING (n, words)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES = {
    "op10_prefix_filter_decontamination": OP10,
    "op11_filter_interaction_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
                              regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY ALL),
             failing AS (
                 SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
                        regexp_matches(text, '[#$%&*|]') AS d,
                        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
                        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
                 FROM texts LEFT JOIN marks USING (doc_id)),
             sets AS (
                 SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*) AS n,
                        count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL),
             filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
             orders AS (
                 SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order
                 FROM filters a, filters b, filters c, filters d, filters e
                 WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
             steps AS (
                 SELECT o.filter_order, x.f, x.bit, instr(o.filter_order, x.f)::INT AS step,
                        (SELECT coalesce(sum(y.bit), 0) FROM filters y
                         WHERE instr(o.filter_order, y.f) < instr(o.filter_order, x.f))::INT AS earlier
                 FROM orders o, filters x),
             found AS (
                 SELECT part, filter_order, step, f,
                        coalesce(sum(n) FILTER ((failed & (earlier | bit)) = 0), 0)::BIGINT AS kept,
                        coalesce(sum(n) FILTER ((failed & bit) > 0 AND (failed & earlier) = 0), 0)::BIGINT AS removed,
                        coalesce(sum(n) FILTER ((failed & bit) > 0 AND (failed & earlier) > 0), 0)::BIGINT AS redundant,
                        coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
                        coalesce(sum(good) FILTER ((failed & bit) > 0 AND (failed & earlier) = 0), 0)::BIGINT AS good_lost,
                        coalesce(sum(toxic) FILTER ((failed & bit) > 0 AND (failed & earlier) = 0), 0)::BIGINT AS toxic_lost
                 FROM sets, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM found""",
    "op12_source_divergence_audit": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
                       FROM documents),
             words AS (SELECT r, lang, source,
                              unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
             kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
             langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
             groups AS (SELECT DISTINCT lang, source FROM texts),
             counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n
                        FROM words JOIN kept USING (lang, term) GROUP BY ALL),
             totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
             shares AS (
                 SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                        1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
                        1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
                 FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
                 LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
                 LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             pairs AS (
                 SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
                 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT s.lang, s.source, o.source AS item, sum((s.p - o.p) * (s.p - o.p) // o.p) AS value
                            FROM shares s JOIN shares o ON s.lang = o.lang AND s.term = o.term GROUP BY ALL) x
                 ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
             found AS (
                 SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
                 UNION ALL
                 SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
                        FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
