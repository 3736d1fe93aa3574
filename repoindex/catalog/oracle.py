"""The result of each registered query, where SQL can state it, for an engine that reads the same tables."""

import re

from repoindex.catalog.views import check_ctes
from repoindex.functions.splitter import SEPARATORS
from repoindex.functions.stemmer import INVARIANT_AFTER_1A, IRREGULAR, STEP_2, STEP_3, STEP_4, STOP_WORDS

WHITESPACE = (r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
DIM = 64


def _tokens(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"


def _literal(text: str) -> str:
    """A string with line ends and tabs as SQL."""
    return "concat(" + ", ".join(f"chr({ord(c)})" if c in "\n\t" else f"'{c}'" for c in text) + ")" if text else "''"


def _separators(language: str) -> str:
    return "[" + ", ".join(map(_literal, SEPARATORS[language])) + "]"


def _hits(table: str, question: str) -> str:
    """Chunks with the number of distinct question lexemes they hold."""
    return f"""SELECT q.query_id, t.namespace, t.kind, t.id, count(DISTINCT t.lexeme) AS held
               FROM {question} q JOIN {table} t ON t.lexeme = q.lexeme GROUP BY ALL"""


def _vector_cells(source: str, key: str, text: str) -> str:
    """Hashed bag of words, by component; ``source`` has one row per key."""
    return f"""
        SELECT {key}, dim, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x
        FROM (SELECT {key}, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % {DIM} AS dim,
                     CAST(count(*) AS DOUBLE) AS n
              FROM (SELECT {key}, unnest({_tokens(text)}) AS w FROM {source}) GROUP BY ALL)"""


def _words(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _suffix_rules(rules: list[tuple[str, str]], region, blocked=lambda suffix: "false") -> str:
    """The first suffix that the word has is replaced if what is before it reaches into its region."""
    cases = []
    for suffix, other in rules:
        stem = f"substr(w, 1, length(w) - {len(suffix)})"
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN length(w) - {len(suffix)} < {region(suffix)} "
                     f"OR {blocked(suffix).format(stem=stem)} THEN w ELSE concat({stem}, '{other}') END")
    return "CASE " + "\n".join(cases) + " ELSE w END"


_SHORT = "regexp_matches({0}, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"
_REGION = "CASE WHEN regexp_matches({0}, '[aeiouy][^aeiouy]') THEN length(regexp_extract({0}, '^.*?[aeiouy][^aeiouy]')) ELSE length({0}) END"
# English stems, step by step over the distinct words: w is the word so far, r1 and r2 where its regions begin.
_STEM_STEPS = [
    "SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM {from}",
    "SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))"
    f" ELSE {_REGION.format('w')} END AS r1 FROM {{from}}",
    f"SELECT *, r1 + {_REGION.format('substr(w, r1 + 1)')} AS r2 FROM {{from}}",
    """SELECT * REPLACE (CASE
            WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
            WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
            WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
            WHEN ends_with(w, 's') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1)
            ELSE w END AS w) FROM {from}""",
    f"SELECT *, w IN {_words(INVARIANT_AFTER_1A)} AS done, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS suffix FROM {{from}}",
    "SELECT *, left(w, length(w) - length(suffix)) AS stem FROM {from}",
    f"""SELECT * REPLACE (CASE
            WHEN done OR suffix = '' THEN w
            WHEN starts_with(suffix, 'ee') THEN CASE WHEN length(stem) >= r1 THEN concat(stem, 'ee') ELSE w END
            WHEN NOT regexp_matches(stem, '[aeiouy]') THEN w
            WHEN regexp_matches(stem, '(at|bl|iz)$') THEN concat(stem, 'e')
            WHEN regexp_matches(stem, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(stem, length(stem) - 1)
            WHEN length(stem) <= r1 AND {_SHORT.format('stem')} THEN concat(stem, 'e') ELSE stem END AS w) FROM {{from}}""",
    """SELECT * REPLACE (CASE WHEN NOT done AND length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$')
                            THEN concat(left(w, length(w) - 1), 'i') ELSE w END AS w) FROM {from}""",
    "SELECT * REPLACE (CASE WHEN done THEN w ELSE " + _suffix_rules(
        STEP_2, lambda s: "r1", lambda s: {"ogi": "NOT ends_with({stem}, 'l')",
                                           "li": "NOT regexp_matches({stem}, '[cdeghkmnrt]$')"}.get(s, "false"))
    + " END AS w) FROM {from}",
    "SELECT * REPLACE (CASE WHEN done THEN w ELSE " + _suffix_rules(
        STEP_3, lambda s: "r2" if s == "ative" else "r1") + " END AS w) FROM {from}",
    "SELECT * REPLACE (CASE WHEN done THEN w ELSE " + _suffix_rules(
        [(s, "") for s in STEP_4], lambda s: "r2",
        lambda s: "NOT regexp_matches({stem}, '[st]$')" if s == "ion" else "false") + " END AS w) FROM {from}",
    f"""SELECT * REPLACE (CASE WHEN done THEN w
            WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
                                        AND NOT {_SHORT.format('left(w, length(w) - 1)')})) THEN left(w, length(w) - 1)
            WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w) FROM {{from}}""",
]


def _stems(words: str) -> str:
    """(word, lexeme) of the words of a query; stop words have none."""
    body = f"({words})"
    for step in _STEM_STEPS:
        body = "(" + step.replace("{from}", body) + ")"
    irregular = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in IRREGULAR.items())
    return rf"""
        SELECT word, CASE word {irregular} ELSE CASE WHEN length(word) <= 2 OR NOT regexp_matches(word, '^\p{{L}}+$')
                                                     THEN word ELSE lower(w) END END AS lexeme
        FROM {body} WHERE word NOT IN {_words(STOP_WORDS)}"""


# Shared steps, each a named query; a query below lists those it needs, in order.
STEPS = {
    **check_ctes(),
    "t_chunks": f"""
        SELECT namespace, kind, id, unnest(range(1, len(w) + 1))::INT AS pos, unnest(w) AS lexeme
        FROM (SELECT namespace, kind, id, {_tokens('text')} AS w FROM v_chunks)""",
    "t_questions": f"""
        SELECT DISTINCT query_id, unnest({_tokens('pair')}) AS lexeme FROM v_queries""",
    "n_questions": "SELECT query_id, count(*) AS n FROM t_questions GROUP BY ALL",
    "t_first": f"""SELECT DISTINCT query_id, unnest({_tokens("split_part(pair, ' ', 1)")}) AS lexeme FROM v_queries""",
    "t_second": f"""SELECT DISTINCT query_id, unnest({_tokens("split_part(pair, ' ', 2)")}) AS lexeme FROM v_queries""",
    "t_any": f"""
        SELECT DISTINCT query_id, unnest({_tokens('passage')}) AS lexeme FROM v_queries""",
    "any_shares": """
        SELECT q.query_id, t.namespace, t.kind, t.id, t.lexeme,
               list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0 / (j * j)))::DOUBLE * 0.1 / 1.64493406685 AS share
        FROM t_any q JOIN t_chunks t ON t.lexeme = q.lexeme GROUP BY ALL""",
    "any_ranked": """
        SELECT s.query_id, s.namespace, s.kind, s.id, CAST(CAST(sum(share) / any_value(n.n) AS FLOAT) AS DOUBLE) AS rank
        FROM any_shares s JOIN (SELECT query_id, count(*) AS n FROM t_any GROUP BY ALL) n USING (query_id) GROUP BY ALL""",
    "any_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace, kind
                                                    ORDER BY rank DESC, id) AS rn FROM any_ranked) WHERE rn <= 20""",
    "held": _hits("t_chunks", "t_questions"),
    "matched": """
        SELECT h.query_id, h.namespace, h.kind, h.id FROM held h JOIN n_questions n
        ON h.query_id = n.query_id AND h.held = n.n""",
    "occurring": """
        SELECT q.query_id, t.id, t.lexeme, t.pos FROM t_questions q JOIN t_chunks t ON t.lexeme = q.lexeme""",
    "term_shares": """
        SELECT query_id, id, lexeme, sum(1.0 / (j * j)) * 0.1 / 1.64493406685 AS share
        FROM (SELECT query_id, id, lexeme,
                     CAST(row_number() OVER (PARTITION BY query_id, id, lexeme ORDER BY pos) AS DOUBLE) AS j
              FROM occurring) GROUP BY ALL""",
    "pair_logs": """
        SELECT a.query_id, a.id,
               -- ln(1 - y), by its series where y is small
               sum(CASE WHEN y < 1e-6 THEN -y * (1.0 + y / 2.0) ELSE ln(1.0 - y) END) AS logs
        FROM occurring a JOIN occurring b
        ON a.query_id = b.query_id AND a.id = b.id AND a.lexeme < b.lexeme,
        LATERAL (SELECT 0.1 * sqrt(CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30::DOUBLE
                     ELSE 1.0 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2.0)) END) AS y)
        GROUP BY ALL""",
    "ranked": """
        SELECT m.query_id, m.namespace, m.kind, m.id,
               CAST(CAST(CASE WHEN n.n = 1 THEN s.share WHEN p.logs > -1e-6 THEN -p.logs * (1.0 + p.logs / 2.0)
                              ELSE 1.0 - exp(p.logs) END AS FLOAT) AS DOUBLE) AS rank
        FROM matched m JOIN n_questions n ON m.query_id = n.query_id
        LEFT JOIN pair_logs p ON m.query_id = p.query_id AND m.id = p.id
        LEFT JOIN (SELECT query_id, id, sum(share) AS share FROM term_shares GROUP BY ALL) s
        ON m.query_id = s.query_id AND m.id = s.id""",
    "text_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace, kind
                                                    ORDER BY rank DESC, id) AS rn FROM ranked) WHERE rn <= 20""",
    "e_stems": _stems("SELECT lexeme AS word FROM t_chunks UNION SELECT lexeme FROM t_any"),
    "e_chunks": "SELECT t.namespace, t.kind, t.id, t.pos, e.lexeme FROM t_chunks t JOIN e_stems e ON e.word = t.lexeme",
    "e_any": "SELECT DISTINCT query_id, e.lexeme FROM t_any t JOIN e_stems e ON e.word = t.lexeme",
    "chunk_cells": _vector_cells("v_chunks", "id", "text"),
    "s_cells": _vector_cells("s_chunks", "id", "text"),
    "s_embedded": f"""
        SELECT c.id, string_agg(CAST(CAST(round(coalesce(CAST(CAST(x AS FLOAT) AS DOUBLE), 0.0) * 100000) AS INT) AS VARCHAR), ','
                                ORDER BY d.dim) AS embedding
        FROM s_chunks c CROSS JOIN (SELECT unnest(range(0, {DIM})) AS dim) d
        LEFT JOIN s_cells x ON x.id = c.id AND x.dim = d.dim GROUP BY ALL""",
    "question_cells": _vector_cells("v_queries", "query_id", "passage"),
    "chunk_lists": f"""
        SELECT c.namespace, c.kind, c.id, list(coalesce(CAST(CAST(x AS FLOAT) AS DOUBLE), 0.0) ORDER BY d.dim) AS e
        FROM v_chunks c CROSS JOIN (SELECT unnest(range(0, {DIM})) AS dim) d
        LEFT JOIN chunk_cells x ON x.id = c.id AND x.dim = d.dim GROUP BY ALL""",
    "question_lists": f"""
        SELECT q.query_id, list(coalesce(CAST(CAST(x AS FLOAT) AS DOUBLE), 0.0) ORDER BY d.dim) AS e
        FROM v_queries q CROSS JOIN (SELECT unnest(range(0, {DIM})) AS dim) d
        LEFT JOIN question_cells x ON x.query_id = q.query_id AND x.dim = d.dim GROUP BY ALL""",
    "distances": """
        SELECT q.query_id, c.namespace, c.kind, c.id,
               CASE WHEN list_dot_product(c.e, c.e) > 0 AND list_dot_product(q.e, q.e) > 0
                    THEN round(1.0 - list_dot_product(q.e, c.e)
                               / sqrt(list_dot_product(c.e, c.e) * list_dot_product(q.e, q.e)), 9) END AS dist
        FROM question_lists q CROSS JOIN chunk_lists c""",
    "vector_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace, kind
                                                    ORDER BY dist ASC NULLS LAST, id) AS rn FROM distances)
        WHERE rn <= 20""",
    "fused": """
        SELECT query_id, namespace, kind, id, v_rn, f_rn,
               round(CAST(1 AS DOUBLE) / (60 + coalesce(v_rn, 100)) + CAST(1 AS DOUBLE) / (60 + coalesce(f_rn, 100)), 9)
               AS score
        FROM (SELECT query_id, namespace, kind, id, v.rn AS v_rn, f.rn AS f_rn
              FROM vector_hits v FULL OUTER JOIN any_hits f USING (query_id, namespace, kind, id))""",
    "hybrid": """
        SELECT f.query_id, f.namespace, f.kind, f.place, f.id, f.score, c.file_path, c.package, c.text
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace, kind ORDER BY score DESC, id) AS place
              FROM fused) f JOIN v_chunks c USING (id) WHERE f.place <= 6""",
    "v_vectors": "SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding::DOUBLE[] AS e FROM embeddings",
    "centroids": """
        SELECT label, list(x ORDER BY pos) AS e
        FROM (SELECT label, pos, avg(x) AS x
              FROM (SELECT label, unnest(range(0, len(e))) AS pos, unnest(e) AS x FROM v_vectors) GROUP BY ALL)
        GROUP BY ALL""",
    # Splitting as ranges of a text: cut at the coarsest separator there is, cut long pieces again, merge runs of short ones.
    "s_files": rf"""
        SELECT f.namespace, f.file_path, p.package, f.text,
               CASE WHEN regexp_matches(f.file_path, '\.(md|txt|yml)$') THEN 'docs' ELSE 'code' END AS kind,
               CASE WHEN regexp_matches(f.file_path, '\.(md|txt|yml)$') THEN 4000 ELSE 2000 END AS size,
               CASE WHEN regexp_matches(f.file_path, '\.(md|txt|yml)$') THEN 400 ELSE 200 END AS overlap,
               CASE WHEN f.file_path LIKE '%.py' THEN {_separators('python')}
                    WHEN f.file_path LIKE '%.ts' THEN {_separators('ts')}
                    WHEN f.file_path LIKE '%.js' THEN {_separators('js')} ELSE {_separators('default')} END AS seps
        FROM v_files f JOIN f_packages p USING (namespace, file_path)
        WHERE NOT regexp_matches(f.file_path, '\.(min\.js|json)$') AND regexp_matches(f.text, '[^{WHITESPACE}]')""",
    "s_pieces": """
        SELECT namespace, file_path, 0 AS owner, 0 AS owner_level, 0::BIGINT AS s, length(text)::BIGINT AS e, 1 AS level,
               'open' AS state FROM s_files
        UNION ALL
        SELECT namespace, file_path, base AS owner, lev AS owner_level, cut AS s,
               coalesce(lead(cut) OVER (PARTITION BY namespace, file_path, base ORDER BY cut), stop) AS e, lev + 1 AS level,
               CASE WHEN sep = '' THEN 'letters'
                    WHEN coalesce(lead(cut) OVER (PARTITION BY namespace, file_path, base ORDER BY cut), stop) - cut < size
                    THEN 'short' ELSE 'open' END AS state
        FROM (SELECT namespace, file_path, base, stop, lev, sep, size,
                     base + CASE i WHEN 1 THEN 0 ELSE
                         coalesce(sum(length(part) + length(sep)) OVER (
                             PARTITION BY namespace, file_path, base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
                         ), 0) - length(sep) END AS cut, i
              FROM (SELECT namespace, file_path, base, stop, lev, sep, size, unnest(parts) AS part,
                           generate_subscripts(parts, 1) AS i
                    FROM (SELECT namespace, file_path, base, stop, lev, size, seps[lev] AS sep,
                                 CASE seps[lev] WHEN '' THEN [body] ELSE string_split(body, seps[lev]) END AS parts
                          FROM (SELECT p.namespace, p.file_path, p.s AS base, p.e AS stop, f.size, f.seps,
                                       substr(f.text, p.s + 1, p.e - p.s) AS body,
                                       list_min(list_filter(range(p.level, len(f.seps) + 1), lambda j:
                                           f.seps[j] = '' OR contains(substr(f.text, p.s + 1, p.e - p.s), f.seps[j]))) AS lev
                                FROM s_pieces p JOIN s_files f USING (namespace, file_path) WHERE p.state = 'open'))))
        -- A separator at the very beginning opens no piece of its own.
        WHERE NOT (i = 2 AND cut = base)""",
    "s_runs": """
        SELECT namespace, file_path, owner, owner_level, list(s ORDER BY s) AS starts, list(e ORDER BY s) AS ends
        FROM (SELECT *, sum(opens) OVER (PARTITION BY namespace, file_path, owner, owner_level ORDER BY s) AS run
              FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY namespace, file_path, owner, owner_level ORDER BY s) = s
                              THEN 0 ELSE 1 END AS opens FROM s_pieces WHERE state = 'short'))
        GROUP BY namespace, file_path, owner, owner_level, run""",
    "s_windows": """
        SELECT r.namespace, r.file_path, starts, ends, f.size, f.overlap, 1::BIGINT AS first,
               len(list_filter(ends, lambda x: x <= starts[1] + f.size))::BIGINT AS last
        FROM s_runs r JOIN s_files f USING (namespace, file_path)
        UNION ALL
        SELECT namespace, file_path, starts, ends, size, overlap, next AS first,
               len(list_filter(ends, lambda x: x <= starts[next] + size))::BIGINT AS last
        FROM (SELECT *, first + 1 + len(list_filter(starts[first + 1:last], lambda x:
                            starts[last + 1] - x > overlap OR ends[last + 1] - x > size)) AS next
              FROM s_windows WHERE last < len(ends))""",
    "s_chunks": rf"""
        SELECT namespace, kind, sha256(concat(namespace, ':', file_path, ':', chunk_index)) AS id, file_path, package,
               chunk_index, text
        FROM (SELECT namespace, kind, file_path, package, text,
                     CAST(row_number() OVER (PARTITION BY namespace, file_path ORDER BY s) - 1 AS INT) AS chunk_index
              FROM (SELECT w.namespace, f.kind, w.file_path, f.package, w.s,
                           regexp_replace(substr(f.text, w.s + 1, w.e - w.s), '^[{WHITESPACE}]+|[{WHITESPACE}]+$', '', 'g')
                           AS text
                    FROM (SELECT namespace, file_path, starts[first] AS s, ends[last] AS e FROM s_windows
                          UNION ALL
                          SELECT namespace, file_path, s + n * (size - overlap) AS s,
                                 least(s + n * (size - overlap) + size, e) AS e
                          FROM (SELECT p.namespace, p.file_path, p.s, p.e, f.size, f.overlap,
                                       unnest(range(0, CAST(ceil(greatest(p.e - p.s - f.size, 0)
                                                                 / (f.size - f.overlap)::DOUBLE) AS BIGINT) + 1)) AS n
                                FROM s_pieces p JOIN s_files f USING (namespace, file_path) WHERE p.state = 'letters')) w
                    JOIN s_files f USING (namespace, file_path)) WHERE text <> '')""",
    "c_changes": """
        SELECT namespace, previous_filename AS file_path, 'deleted' AS op FROM v_changes WHERE status = 'renamed'
        UNION ALL SELECT namespace, file_path, CASE status WHEN 'removed' THEN 'deleted' ELSE 'changed' END
        FROM v_changes""",
    "c_latest": """
        SELECT namespace, file_path, CASE status WHEN 'removed' THEN 'deleted' ELSE 'changed' END AS op
        FROM (SELECT *, row_number() OVER (PARTITION BY namespace, file_path ORDER BY ts DESC, event_id DESC) AS r
              FROM v_changes) WHERE r = 1""",
    "f_packages": """
        SELECT f.namespace, f.file_path, coalesce(arg_max(m.name, length(m.dir)), '') AS package
        FROM v_files f LEFT JOIN v_manifests m
        ON m.namespace = f.namespace AND starts_with(f.file_path, concat(m.dir, '/')) GROUP BY ALL""",
    "c_lines": "SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS text "
               "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "c_diffs": """
        SELECT namespace, count(DISTINCT CAST(ts AS DATE)) AS ahead_by, count(DISTINCT file_path) AS files
        FROM v_changes GROUP BY ALL""",
    "c_plan": """
        SELECT r.namespace, r.repo_url, r.last_commit_sha, h.sha AS head, substr(h.sha, 1, 8) AS short_head,
               CASE WHEN h.sha IS NULL THEN 'failed' WHEN h.sha = r.last_commit_sha THEN 'up_to_date'
                    WHEN r.last_commit_sha IS NULL THEN 'full_baseline'
                    WHEN d.ahead_by > 250 OR d.files >= 300 THEN 'full_too_large'
                    WHEN d.files = 0 THEN 'noop_advance' WHEN d.files > 0 THEN 'incremental'
                    ELSE 'failed' END AS action
        FROM v_registry r LEFT JOIN v_heads h USING (namespace) LEFT JOIN c_diffs d USING (namespace)""",
    # What a sync deletes by path, and the chunks it brings.
    "c_listed": """
        SELECT namespace, file_path, op FROM c_latest JOIN c_plan USING (namespace) WHERE action = 'incremental'""",
    "c_incoming": """
        SELECT s.* FROM s_chunks s
        WHERE namespace IN (SELECT namespace FROM c_plan WHERE action LIKE 'full%')
              OR (namespace, file_path) IN (SELECT (namespace, file_path) FROM c_listed WHERE op = 'changed')""",
}

# The same searches over English lexemes.
_ENGLISH = {"t_any": "e_any", "t_chunks": "e_chunks", "any_shares": "e_shares", "any_ranked": "e_ranked",
            "any_hits": "e_hits", "fused": "e_fused", "hybrid": "e_hybrid"}
for _name in ("any_shares", "any_ranked", "any_hits", "fused", "hybrid"):
    _body = STEPS[_name]
    for _old, _new in _ENGLISH.items():
        _body = re.sub(rf"\b{_old}\b", _new, _body)
    STEPS[_ENGLISH[_name]] = _body

# The chunks of old texts, and searches over the chunks of the present ones.
for _name in ("s_files", "s_pieces", "s_runs", "s_windows", "s_chunks"):
    STEPS[_name.replace("s_", "o_")] = re.sub(r"\bs_(files|pieces|runs|windows|chunks)\b", r"o_\1", STEPS[_name])
STEPS["o_files"] = STEPS["o_files"].replace(
    "p.package, f.text,", "'' AS package, concat('old: ', f.text, chr(10), f.text) AS text,")
_STORED = {"v_chunks": "s_chunks", "t_chunks": "x_chunks", "chunk_cells": "s_cells", "chunk_lists": "x_lists",
           "distances": "x_distances", "vector_hits": "x_vector_hits", "any_shares": "x_shares", "any_ranked": "x_ranked",
           "any_hits": "x_hits", "fused": "x_fused", "hybrid": "x_hybrid"}
for _name in [n for n in _STORED if n not in ("v_chunks", "chunk_cells")]:
    _body = STEPS[_name]
    for _old, _new in _STORED.items():
        _body = re.sub(rf"\b{_old}\b", _new, _body)
    STEPS[_STORED[_name]] = _body

_FILES = ["v_files"]
_CHUNKS = ["v_files", "v_chunks"]
_MATCH = [*_CHUNKS, "v_queries", "t_chunks", "t_questions", "n_questions", "held", "matched"]
_RANK = [*_MATCH, "occurring", "term_shares", "pair_logs", "ranked"]
_VECTOR = ["chunk_cells", "question_cells", "chunk_lists", "question_lists", "distances", "vector_hits"]
_ANY = [*_CHUNKS, "v_queries", "t_chunks", "t_any", "any_shares", "any_ranked"]
_STEMMED = [*_CHUNKS, "v_queries", "t_chunks", "t_any", "e_stems", "e_chunks"]
_FUSED = [*_ANY, "any_hits", *_VECTOR, "fused"]
_HYBRID = [*_FUSED, "hybrid"]
_CHANGES = ["v_files", "v_changes"]
_SPLIT = ["v_files", "v_manifests", "f_packages", "s_files", "s_pieces", "s_runs", "s_windows", "s_chunks"]
_OLD = ["o_files", "o_pieces", "o_runs", "o_windows", "o_chunks"]
_SEARCHED = [*_SPLIT, "v_queries", "x_chunks", "t_any", "x_shares", "x_ranked", "x_hits", "s_cells", "question_cells", "x_lists",
             "question_lists", "x_distances", "x_vector_hits", "x_fused", "x_hybrid"]
_ROWS = "namespace, kind, id, file_path, package, chunk_index, text"
_UNNAMED = _ROWS.replace("package", "'' AS package")
_REINDEXED = ([*_SPLIT, *_OLD, "v_changes", "c_latest"], f"""
    SELECT {_ROWS} FROM o_chunks
    WHERE (namespace, file_path) NOT IN (SELECT (namespace, file_path) FROM c_latest)
    UNION ALL SELECT {_UNNAMED} FROM s_chunks
    WHERE (namespace, file_path) IN (SELECT (namespace, file_path) FROM c_latest WHERE op = 'changed')""")
_SYNCED = [*_SPLIT, *_OLD, "v_changes", "c_latest", "v_registry", "v_heads", "c_diffs", "c_plan", "c_listed", "c_incoming"]

# Query → steps it needs, and its final SELECT.
CHECKS: dict[str, tuple[list[str], str]] = {
    "scan_files": (_FILES, """
        SELECT 'corpus' AS namespace, concat(namespace, '/', file_path) AS file_path, sha256(text) AS text_hash
        FROM v_files"""),
    "scan_trees": ([*_FILES, "v_manifests"], """
        SELECT namespace, file_path, strlen(text) AS size, sha256(text) AS text_hash
        FROM (SELECT namespace, file_path, text FROM v_files
              UNION ALL SELECT namespace, concat(dir, '/package.json'), concat('{"name":"', name, '"}') FROM v_manifests)"""),
    "ingest_trees": (_SPLIT, f"SELECT {_ROWS} FROM s_chunks"),
    "reindex_trees": ([*_SPLIT, *_OLD, "v_changes", "c_latest"], f"""
        SELECT {_ROWS} FROM o_chunks
        WHERE (namespace, file_path) NOT IN (SELECT (namespace, file_path) FROM c_latest)
        UNION ALL SELECT {_ROWS} FROM s_chunks
        WHERE (namespace, file_path) IN (SELECT (namespace, file_path) FROM c_latest WHERE op = 'changed')"""),
    "changed_files": ([*_CHANGES, "c_latest"], """
        SELECT f.namespace, f.file_path, length(f.text) AS chars
        FROM v_files f JOIN c_latest c USING (namespace, file_path) WHERE c.op = 'changed'"""),
    "decode_text_files": (_FILES, r"""
        SELECT namespace, file_path, replace(text, ' ', chr(10)) AS text FROM v_files"""),
    "manifests": ([], """
        SELECT DISTINCT concat('ns_', lang) AS namespace, concat('packages/', source) AS dir,
               concat('@corpus/', source) AS name
        FROM documents WHERE CAST(substr(source, 4) AS INT) % 4 = 0"""),
    "compare_files": ([*_CHANGES], """
        SELECT concat(namespace, '_', strftime(ts, '%Y%m%d')) AS namespace, CAST(dayofyear(ts) AS INT) AS ahead_by,
               status, file_path AS filename, previous_filename FROM v_changes"""),
    "latest_heads": ([], """
        SELECT concat('user_', user_id) AS namespace, md5(CAST(event_id AS VARCHAR)) AS sha
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(CAST(event_id AS VARCHAR)) DESC)
                     AS r FROM events) WHERE r = 1"""),
    "missing_namespace_empty": (_FILES, "SELECT namespace, file_path FROM v_files WHERE namespace = 'ns_absent'"),
    "parse_path_lists": ([], r"""
        SELECT role AS namespace, file_path, 'changed' AS op, count(*) AS times
        FROM (SELECT role, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS file_path FROM conversations)
        WHERE file_path <> '' GROUP BY ALL"""),
    "sanitise_namespace": ([], """
        SELECT page_id, regexp_replace(lower(url), '[^a-z0-9_]', '_', 'g') AS namespace FROM pages"""),
    "skip_filter": (_FILES, "SELECT namespace, file_path FROM v_files WHERE file_path NOT LIKE '%.min.js'"),
    "route_kind": (_FILES, r"""
        SELECT namespace, file_path,
               CASE WHEN regexp_matches(file_path, '\.(ts|tsx|js|jsx|py|java|go|rs|sql)$') THEN 'code'
                    WHEN regexp_matches(file_path, '\.(md|txt|rst|yml|yaml|toml)$') THEN 'docs' END AS kind
        FROM v_files"""),
    "drop_blank": (["c_lines"], f"""
        SELECT doc_id, count(*) AS lines, CAST(sum(line) AS BIGINT) AS line_sum FROM c_lines
        WHERE regexp_matches(text, '[^{WHITESPACE}]') GROUP BY ALL"""),
    "parse_repo_url": ([], r"""
        SELECT page_id, p[-2] AS owner, CASE WHEN len(p) >= 2 THEN regexp_replace(p[-1], '\.git$', '') END AS repo
        FROM (SELECT page_id, string_split(rtrim(url, '/'), '/') AS p FROM pages)"""),
    "chunk_label": (["v_files", "v_manifests", "f_packages"], """
        SELECT namespace, file_path, CASE WHEN package <> '' THEN concat(package, '/', file_path) ELSE file_path END
               AS label FROM f_packages"""),
    "chunk_ids": (_CHUNKS, "SELECT namespace, file_path, chunk_index, id FROM v_chunks"),
    "constraint_violations": (_FILES, """
        WITH r AS (SELECT sha256(concat(f.namespace, ':', f.file_path, ':0')) AS id, f.file_path, f.text,
                          e.embedding FROM v_files f LEFT JOIN embeddings e ON f.doc_id = e.vec_id)
        SELECT id, 'embedding is null' AS violation FROM r WHERE embedding IS NULL
        UNION ALL SELECT id, 'text is null' FROM r WHERE file_path LIKE '%.md'
        UNION ALL SELECT id, 'embedding dimension' FROM r WHERE embedding IS NOT NULL AND length(text) >= 2000"""),
    "batch_counts": (_CHUNKS, """
        SELECT namespace, kind, count(*) AS chunks, CAST(ceil(count(*) / 64) AS BIGINT) AS batches
        FROM v_chunks GROUP BY ALL"""),
    "chunk_code": (_SPLIT, r"SELECT * FROM s_chunks WHERE regexp_matches(file_path, '\.(go|sql)$')"),
    "chunk_docs": (_SPLIT, "SELECT * FROM s_chunks WHERE kind = 'docs'"),
    "chunk_lang": (_SPLIT, r"SELECT * FROM s_chunks WHERE regexp_matches(file_path, '\.(py|ts|js)$')"),
    "chunk_rows_all": (_SPLIT, "SELECT * FROM s_chunks"),
    "chunk_invariants": (_SPLIT, """
        SELECT c.namespace, c.file_path, bool_and(length(c.text) <= f.size) AS within_limit,
               bool_and(trim(c.text) <> '') AS no_blank, bool_and(contains(f.text, c.text)) AS substrings,
               max(c.chunk_index) + 1 = count(*) AS contiguous, count(DISTINCT c.id) = count(*) AS unique_ids,
               count(*) AS chunks, CAST(sum(length(c.text)) AS BIGINT) AS chars, max(length(c.text)) AS longest
        FROM s_chunks c JOIN s_files f USING (namespace, file_path) GROUP BY ALL"""),
    "ingest_chunks": ([*_SPLIT, "s_cells", "s_embedded"], """
        SELECT c.id, e.embedding, c.text, c.file_path, c.package, c.chunk_index, c.namespace, c.kind
        FROM s_chunks c JOIN s_embedded e USING (id)"""),
    "embed_chunks": ([*_CHUNKS, "chunk_cells"], """
        SELECT id, CAST(dim AS INT) AS dim, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x FROM chunk_cells"""),
    "embed_queries": (["v_queries", "question_cells"], """
        SELECT query_id, CAST(dim AS INT) AS dim, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x
        FROM question_cells"""),
    "embed_backend": (_CHUNKS, """
        SELECT id, CAST(length(text) AS DOUBLE) AS chars,
               CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
               CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS lines FROM v_chunks"""),
    "hash_embed_documents": ([], f"""
        SELECT doc_id, CAST(dim AS INT) AS dim, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x
        FROM ({_vector_cells('documents', 'doc_id', 'text')})"""),
    "nearest_package_names": (["v_files", "v_manifests", "f_packages"],
                              "SELECT namespace, file_path, package FROM f_packages"),
    "table_stats": (_CHUNKS, """
        SELECT namespace, kind, count(DISTINCT file_path) AS files, count(*) AS chunks FROM v_chunks GROUP BY ALL"""),
    "chunk_counts": (_CHUNKS, "SELECT kind, count(*) AS chunks FROM v_chunks GROUP BY ALL"),
    "deleted_counts": ([*_CHUNKS, "v_changes", "c_changes"], """
        SELECT namespace, file_path, CAST(count(*) AS BIGINT) AS deleted
        FROM v_chunks WHERE (namespace, file_path) IN (SELECT (namespace, file_path) FROM c_changes)
        GROUP BY GROUPING SETS ((namespace, file_path), ())"""),
    "lexemes_simple": ([*_CHUNKS, "t_chunks"], "SELECT id, pos, lexeme FROM t_chunks"),
    "postings": ([*_CHUNKS, "t_chunks"], """
        SELECT namespace, kind, id, lexeme, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
        FROM t_chunks GROUP BY ALL"""),
    "lexemes_english": (_STEMMED, "SELECT id, pos, lexeme FROM e_chunks"),
    "postings_english": (_STEMMED, """
        SELECT namespace, kind, id, lexeme, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
        FROM e_chunks GROUP BY ALL"""),
    "hybrid_english": ([*_STEMMED, "e_any", "e_shares", "e_ranked", "e_hits", *_VECTOR, "e_fused", "e_hybrid"], """
        SELECT query_id, namespace, kind, place, id, score, file_path, package FROM e_hybrid"""),
    "query_clauses_simple": (["v_queries"], """
        WITH w AS (SELECT query_id, list_transform(regexp_extract_all(passage, '[A-Za-z]+'), lambda x: lower(x)) AS w
                   FROM v_queries),
             f AS (SELECT query_id, w, len(w) AS n, unnest(range(0, CAST(ceil(len(w) / 4.0) AS INT))) AS k FROM w),
             q AS (SELECT query_id * 1000 + k AS query_id, [w[(4 * k) % n + 1], w[(4 * k + 1) % n + 1],
                          w[(4 * k + 2) % n + 1], w[(4 * k + 3) % n + 1]] AS w FROM f)
        SELECT query_id, 0 AS or_group, 0 AS clause_id, w[1] AS lexeme, 0 AS "offset", false AS negated FROM q
        UNION ALL SELECT query_id, 0, 1, w[2], 0, false FROM q
        UNION ALL SELECT query_id, 0, 1, w[3], 1, false FROM q
        UNION ALL SELECT query_id, 1, 2, w[4], 0, true FROM q"""),
    "fts_match_all": (_MATCH, "SELECT * FROM matched"),
    "fts_match_phrase": ([*_CHUNKS, "v_queries", "t_chunks"], f"""
        WITH p AS (SELECT query_id, unnest(range(0, len(w)))::INT AS "offset", unnest(w) AS lexeme, len(w) AS n
                   FROM (SELECT query_id, {_tokens('pair')} AS w FROM v_queries))
        SELECT DISTINCT query_id, namespace, kind, id
        FROM (SELECT p.query_id, t.namespace, t.kind, t.id, t.pos - p."offset" AS start, p.n, count(*) AS c
              FROM p JOIN t_chunks t ON t.lexeme = p.lexeme GROUP BY ALL) WHERE c = n"""),
    "fts_match_any": (_ANY, "SELECT query_id, namespace, kind, id FROM any_ranked"),
    "fts_match_not": ([*_CHUNKS, "v_queries", "t_chunks", "t_first", "t_second"], f"""
        SELECT query_id, namespace, kind, id FROM ({_hits('t_chunks', 't_first')})
        WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM ({_hits('t_chunks', 't_second')}))"""),
    "fts_ranks": (_RANK, "SELECT * FROM ranked"),
    "fts_ranks_any": (_ANY, "SELECT * FROM any_ranked"),
    "text_index_counts": ([*_CHUNKS, "t_chunks"], """
        SELECT namespace, kind, lexeme, count(*) AS chunks, CAST(max(n) AS INT) AS most
        FROM (SELECT namespace, kind, id, lexeme, count(*) AS n FROM t_chunks GROUP BY ALL) GROUP BY ALL"""),
    "text_index_topk": ([*_RANK, "text_hits"], "SELECT * FROM text_hits"),
    "text_index_topk_any": ([*_ANY, "any_hits"], "SELECT * FROM any_hits"),
    "text_negation_topk": ([*_CHUNKS, "v_queries", "t_chunks", "t_second"], """
        SELECT * FROM (
            SELECT q.query_id, c.namespace, c.kind, c.id, 0.0::DOUBLE AS rank,
                   row_number() OVER (PARTITION BY q.query_id, c.namespace, c.kind ORDER BY c.id) AS rn
            FROM (SELECT DISTINCT query_id FROM t_second) q CROSS JOIN v_chunks c
            WHERE (q.query_id, c.id) NOT IN (
                SELECT (s.query_id, t.id) FROM t_second s JOIN t_chunks t ON t.lexeme = s.lexeme)) WHERE rn <= 20"""),
    "fts_topk_hits": ([*_RANK, "text_hits"], "SELECT * FROM text_hits"),
    "cosine_distances": (["v_vectors", "centroids"], """
        SELECT v.id, round(1.0 - list_dot_product(v.e, c.e)
                           / sqrt(list_dot_product(v.e, v.e) * list_dot_product(c.e, c.e)), 9) AS dist
        FROM v_vectors v JOIN centroids c USING (label)"""),
    "vector_topk_hits": (["v_vectors", "centroids"], """
        SELECT query_id, 'corpus' AS namespace, 'code' AS kind, id, dist, rn
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rn
              FROM (SELECT CAST(c.label AS BIGINT) AS query_id, v.id, round(1.0 - list_dot_product(v.e, c.e)
                           / sqrt(list_dot_product(v.e, v.e) * list_dot_product(c.e, c.e)), 9) AS dist
                    FROM centroids c CROSS JOIN v_vectors v)) WHERE rn <= 20"""),
    "vector_topk_many": (["v_vectors"], """
        SELECT query_id, 'corpus' AS namespace, 'code' AS kind, id, dist, rn
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rn
              FROM (SELECT CAST(q.id AS BIGINT) AS query_id, v.id, round(1.0 - list_dot_product(v.e, q.e)
                           / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)), 9) + 0.0 AS dist
                    FROM v_vectors q CROSS JOIN v_vectors v)) WHERE rn <= 20"""),
    "vector_cells_recall": (["v_vectors"], """
        SELECT count(*) AS questions, CAST(sum(least(20, (SELECT count(*) FROM v_vectors))) AS BIGINT) AS neighbours,
               true AS reached FROM v_vectors"""),
    "rrf_fused": (_FUSED, "SELECT * FROM fused"),
    "hybrid_topk_hits": (_HYBRID, "SELECT * FROM hybrid"),
    "hybrid_topk_overall": (_FUSED, """
        SELECT f.query_id, f.namespace, f.kind, f.place, f.id, f.score, c.file_path, c.package
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place
              FROM fused) f JOIN v_chunks c USING (id) WHERE f.place <= 6"""),
    "hybrid_multi_namespace": (_HYBRID, """
        SELECT query_id, namespace, kind, place, id, score, file_path, package FROM hybrid
        WHERE namespace IN ('ns_en', 'ns_fr')"""),
    "hybrid_docs_only": (_HYBRID, """
        SELECT query_id, namespace, kind, place, id, score, file_path, package FROM hybrid WHERE kind = 'docs'"""),
    "hybrid_per_question_namespace": (_HYBRID, """
        SELECT query_id, namespace, kind, place, id, score, file_path, package FROM hybrid
        WHERE list_contains([['ns_en', 'ns_fr'], ['ns_de', 'ns_es'], ['ns_fr', 'ns_de']][query_id % 3 + 1], namespace)"""),
    "context_strings": (_HYBRID, r"""
        SELECT q.query_id, coalesce(string_agg(concat('# ', h.file_path, chr(10), h.text),
               concat(chr(10), chr(10), '---', chr(10), chr(10))
               ORDER BY h.namespace, CASE h.kind WHEN 'code' THEN 0 ELSE 1 END, h.place),
               '(No relevant context found: index the repository first.)') AS context
        FROM v_queries q LEFT JOIN hybrid h USING (query_id) GROUP BY ALL"""),
    "prompt_messages": (_CHUNKS, r"""
        WITH asked AS (SELECT conv_id AS query_id, max(turn) AS last, arg_max(text, turn) AS question
                       FROM conversations WHERE role = 'user' GROUP BY ALL),
             ctx AS (SELECT a.query_id, coalesce(string_agg(concat('# ', c.file_path, chr(10), c.text),
                            concat(chr(10), chr(10), '---', chr(10), chr(10))
                                                            ORDER BY c.chunk_index),
                            '(No relevant context found: index the repository first.)') AS context
                     FROM asked a LEFT JOIN v_files f ON f.doc_id = a.query_id
                     LEFT JOIN v_chunks c ON c.namespace = f.namespace AND c.file_path = f.file_path
                     GROUP BY a.query_id)
        SELECT query_id, 0 AS part, CAST(0 AS BIGINT) AS turn, 'system' AS role,
               concat('Answer the question from the retrieved context below, and say so where the context has no answer.',
                      chr(10), chr(10), '## Retrieved context', chr(10), chr(10), context) AS content FROM ctx
        UNION ALL SELECT a.query_id, 1, c.turn, c.role, c.text
        FROM conversations c JOIN asked a ON c.conv_id = a.query_id AND c.turn < a.last
        UNION ALL SELECT query_id, 2, 0, 'user', question FROM asked"""),
    "upsert_chunks": (_CHUNKS, f"""
        SELECT namespace, kind, id, file_path, package, chunk_index,
               CASE WHEN chunk_index > 0 THEN concat('old: ', text) ELSE text END AS text FROM v_chunks
        UNION ALL SELECT namespace, kind, sha256(concat('new:', id)), file_path, 'added', chunk_index, text
        FROM v_chunks WHERE chunk_index = 0"""),
    "delete_chunks": ([*_CHUNKS, "v_changes", "c_changes"], """
        SELECT * FROM v_chunks WHERE (namespace, file_path) NOT IN (
            SELECT (namespace, file_path) FROM c_changes WHERE op = 'deleted')"""),
    "ingest_store": ([*_SPLIT, *_OLD], f"""
        SELECT {_ROWS} FROM s_chunks UNION ALL SELECT {_ROWS} FROM o_chunks WHERE id NOT IN (SELECT id FROM s_chunks)"""),
    "hybrid_over_store": (_SEARCHED, """
        SELECT query_id, namespace, kind, place, id, score, file_path, package FROM x_hybrid"""),
    "hybrid_over_indexes": (_SEARCHED, """
        SELECT query_id, namespace, kind, place, id, score, file_path, package FROM x_hybrid"""),
    "store_postings": ([*_SPLIT, *_OLD], f"""
        SELECT namespace, kind, id, lexeme, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
        FROM (SELECT namespace, kind, id, unnest(range(1, len(w) + 1))::INT AS pos, unnest(w) AS lexeme
              FROM (SELECT namespace, kind, id, {_tokens('text')} AS w FROM s_chunks
                    UNION ALL SELECT namespace, kind, id, {_tokens('text')} FROM o_chunks
                    WHERE id NOT IN (SELECT id FROM s_chunks))) GROUP BY ALL"""),
    "reindex_store": _REINDEXED,
    "reindex_raw_namespace": _REINDEXED,
    "stream_late_events": _REINDEXED,
    "stream_reindexed": _REINDEXED,
    "sync_apply": (_SYNCED, f"""
        SELECT {_UNNAMED} FROM c_incoming
        UNION ALL SELECT {_ROWS} FROM o_chunks
        WHERE (namespace, file_path) NOT IN (SELECT (namespace, file_path) FROM c_listed)
              AND id NOT IN (SELECT id FROM c_incoming)"""),
    "sync_report": (_SYNCED, """
        SELECT p.namespace, p.action, p.short_head, CASE p.action WHEN 'failed' THEN 'failed' ELSE 'ok' END AS status,
               coalesce(d.n, 0) AS deleted, coalesce(i.n, 0) AS chunks
        FROM c_plan p
        LEFT JOIN (SELECT namespace, count(*) AS n FROM o_chunks JOIN c_listed USING (namespace, file_path)
                   GROUP BY ALL) d USING (namespace)
        LEFT JOIN (SELECT namespace, count(*) AS n FROM c_incoming GROUP BY ALL) i USING (namespace)"""),
    "sync_registry": ([*_CHANGES, "v_registry", "v_heads", "c_diffs", "c_plan"], """
        SELECT namespace, repo_url,
               CASE WHEN action IN ('failed', 'up_to_date') THEN last_commit_sha ELSE head END AS last_commit_sha,
               CASE WHEN action IN ('failed', 'up_to_date') THEN TIMESTAMP '2024-01-01 00:00:00'
                    ELSE TIMESTAMP '2024-06-01 00:00:00' END AS last_indexed_at FROM c_plan"""),
    "classify_diff": ([*_CHANGES, "c_changes"], "SELECT * FROM c_changes"),
    "diff_too_large": (_CHANGES, """
        SELECT concat(namespace, '_', strftime(ts, '%Y%m%d')) AS namespace,
               CAST(dayofyear(min(ts)) AS INT) AS ahead_by, count(*) AS files,
               dayofyear(min(ts)) > 20 OR count(*) >= 20 AS too_large FROM v_changes GROUP BY 1"""),
    "sync_plan": ([*_CHANGES, "v_registry", "v_heads", "c_diffs", "c_plan"], "SELECT * FROM c_plan"),
    "register_namespace": (["v_registry"], """
        WITH u AS (SELECT DISTINCT source AS name FROM documents
                   UNION SELECT DISTINCT concat('NS-', lang) FROM documents),
             n AS (SELECT regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g') AS namespace,
                          concat('https://example.org/new/', name) AS repo_url,
                          CASE WHEN name NOT LIKE 'src1%' THEN md5(name) END AS last_commit_sha,
                          TIMESTAMP '2024-06-01 00:00:00' AS last_indexed_at FROM u)
        SELECT * FROM v_registry WHERE namespace NOT IN (SELECT namespace FROM n) UNION ALL SELECT * FROM n"""),
    "advance_sha": (["v_registry", "v_heads"], """
        SELECT r.namespace, r.repo_url,
               CASE WHEN h.namespace IS NOT NULL THEN h.sha ELSE r.last_commit_sha END AS last_commit_sha,
               CASE WHEN h.namespace IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE r.last_indexed_at END
               AS last_indexed_at
        FROM v_registry r LEFT JOIN (SELECT * FROM v_heads WHERE namespace <> 'ns_de') h USING (namespace)"""),
    "registered_namespaces": (["v_registry"], "SELECT namespace, repo_url, last_commit_sha FROM v_registry"),
    "latest_changes": ([*_CHANGES, "c_latest"], "SELECT * FROM c_latest"),
    "list_namespaces": (_CHUNKS, "SELECT DISTINCT namespace FROM v_chunks WHERE kind = 'code'"),
    "get_file": ([*_CHUNKS, "v_changes"], r"""
        SELECT a.namespace, a.file_path,
               CASE WHEN count(c.id) > 0 THEN concat('# ', a.file_path, chr(10), chr(10),
                        string_agg(c.text, concat(chr(10), chr(10), '---', chr(10), chr(10))
                                   ORDER BY c.kind, c.chunk_index))
                    ELSE concat('(No content found for ''', a.file_path, ''' in namespace ''', a.namespace, ''')')
               END AS content
        FROM (SELECT DISTINCT namespace, file_path FROM v_changes) a
        LEFT JOIN v_chunks c USING (namespace, file_path) GROUP BY a.namespace, a.file_path"""),
    "namespace_info": ([*_CHUNKS, "v_registry"], """
        SELECT r.namespace, r.repo_url, r.last_commit_sha,
               concat(strftime(r.last_indexed_at, '%Y-%m-%dT%H:%M:%S'),
                      CASE WHEN microsecond(r.last_indexed_at) % 1000000 = 0 THEN ''
                           ELSE strftime(r.last_indexed_at, '.%f') END, '+00:00') AS last_indexed_at,
               count(DISTINCT CASE kind WHEN 'code' THEN file_path END) AS code_files,
               count(CASE kind WHEN 'code' THEN 1 END) AS code_chunks,
               count(DISTINCT CASE kind WHEN 'docs' THEN file_path END) AS doc_files,
               count(CASE kind WHEN 'docs' THEN 1 END) AS doc_chunks, count(kind) AS total_chunks
        FROM v_registry r LEFT JOIN v_chunks c USING (namespace) GROUP BY ALL"""),
    "namespace_info_asked": ([*_CHUNKS, "v_registry"], """
        WITH a AS (SELECT source AS namespace FROM documents WHERE source IS NOT NULL
                   UNION SELECT concat('ns_', lang) FROM documents)
        SELECT a.namespace, r.repo_url, r.last_commit_sha,
               CASE WHEN r.last_indexed_at IS NOT NULL THEN concat(strftime(r.last_indexed_at, '%Y-%m-%dT%H:%M:%S'),
                      CASE WHEN microsecond(r.last_indexed_at) % 1000000 = 0 THEN ''
                           ELSE strftime(r.last_indexed_at, '.%f') END, '+00:00') END AS last_indexed_at,
               count(DISTINCT CASE kind WHEN 'code' THEN file_path END) AS code_files,
               count(CASE kind WHEN 'code' THEN 1 END) AS code_chunks,
               count(DISTINCT CASE kind WHEN 'docs' THEN file_path END) AS doc_files,
               count(CASE kind WHEN 'docs' THEN 1 END) AS doc_chunks, count(kind) AS total_chunks
        FROM a LEFT JOIN v_registry r USING (namespace) LEFT JOIN v_chunks c USING (namespace) GROUP BY ALL"""),
    "list_files": (_CHUNKS, """
        SELECT DISTINCT namespace, file_path FROM v_chunks
        WHERE namespace = 'ns_en' AND starts_with(file_path, 'packages/src1')"""),
    "repo_tree": (_CHUNKS, """
        WITH p AS (SELECT DISTINCT namespace, file_path, string_split(file_path, '/') AS w FROM v_chunks)
        SELECT DISTINCT namespace, concat(array_to_string(w[1:n], '/'), '/') AS entry
        FROM (SELECT namespace, w, unnest(range(1, least(len(w), 4))) AS n FROM p)
        UNION SELECT namespace, file_path FROM p WHERE len(w) <= 4"""),
    "repo_tree_pages": ([], r"""
        WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS f FROM pages),
             s AS (SELECT f, string_split(f, '/') AS w FROM p)
        SELECT DISTINCT 'pages' AS namespace, concat(array_to_string(w[1:n], '/'), '/') AS entry
        FROM (SELECT w, unnest(range(1, least(len(w), 2))) AS n FROM s)
        UNION SELECT 'pages', f FROM s WHERE len(w) <= 2"""),
}


RECURSIVE = {"s_pieces", "s_windows", "o_pieces", "o_windows"}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (steps, final) in CHECKS.items():
        ctes = ",\n".join(f"{step} AS ({STEPS[step]})" for step in steps)
        opening = "WITH RECURSIVE" if RECURSIVE & set(steps) else "WITH"
        final = final.strip()
        if not ctes:
            out[name] = final
        elif final.upper().startswith("WITH "):
            out[name] = f"{opening} {ctes},\n{final[5:]}"
        else:
            out[name] = f"{opening} {ctes}\n{final}"
    return out
