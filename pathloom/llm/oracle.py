"""SQL for the word-based problems: forms, words and bare texts written anew for DuckDB, and plain joins over them.

The character table is that of module ``text``; everything else (compositions by the engine's own
normalization, marks by regular expressions, near-duplicates by a single-token prefix filter)
is independent of the operators.
"""

from __future__ import annotations

from .text import CHANGED, MARKS

_BLANK = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f ]+"
#: Stands beside a mark that is kept.
_S = ""


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words_sql(source: str) -> str:
    """CTEs from ``source``, a query with (tab, id, text): txt(r, tab, id, text, form, w, bare) of all rows with words; repeated rows once."""
    table = ", ".join(f"({ord(c)}, {_literal(to)})" for c, to in sorted(CHANGED.items()))
    marks = "[" + MARKS.replace("'", "''").replace(".", "\\.").replace("?", "\\?") + "]"
    kept = f"regexp_replace({{}}, '([0-9])({marks})([0-9])', '\\1{_S}\\2{_S}\\3', 'g')"
    return f"""
    shapes(cp, plain) AS (VALUES {table}),
    src AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT tab, id, text FROM ({source}) WHERE id IS NOT NULL AND text IS NOT NULL)),
    ch AS (SELECT r, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '(?s).') AS cs FROM src WHERE strlen(text) <> length(text))),
    shaped AS (SELECT r, nfc_normalize(string_agg(coalesce(plain, c), '' ORDER BY i)) AS t FROM ch LEFT JOIN shapes ON cp = unicode(c) GROUP BY r),
    formed AS (SELECT src.*, trim(regexp_replace(coalesce(t, CASE WHEN strlen(text) = length(text) THEN text ELSE '' END), '{_BLANK}', ' ', 'g'), ' ') AS form FROM src LEFT JOIN shaped USING (r)),
    bared AS (SELECT *, replace(replace(replace(lower(replace(regexp_replace({kept.format(kept.format('form'))}, '(^|[^{_S}]){marks}+', '\\1', 'g'), '{_S}', '')), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's') AS low FROM formed),
    txt AS (SELECT r, tab, id, text, form, list_filter(string_split(low, ' '), lambda x: x <> '') AS w, replace(low, ' ', '') AS bare FROM bared WHERE replace(low, ' ', '') <> '')"""


#: Near-duplicate pairs (ra, rb) of rows of ``txt`` in one table.
NEAR_SQL = """
    tok AS (SELECT r, tab, len(w) AS n, word || chr(1) || row_number() OVER (PARTITION BY r, word) AS token FROM (SELECT r, tab, w, unnest(w) AS word FROM txt)),
    df AS (SELECT tab, token, count(*) AS df FROM tok GROUP BY 1, 2),
    pre AS (SELECT r, tab, n, token FROM tok JOIN df USING (tab, token) QUALIFY row_number() OVER (PARTITION BY r ORDER BY df, token) <= n - (7 * n + 9) // 10 + 1),
    cand AS (SELECT DISTINCT a.r AS ra, b.r AS rb, greatest(a.n, b.n) AS longer FROM pre a JOIN pre b ON a.tab = b.tab AND a.token = b.token AND a.r < b.r WHERE 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)),
    near AS (SELECT ra, rb FROM cand JOIN tok a ON a.r = ra JOIN tok b ON b.r = rb AND a.token = b.token GROUP BY ra, rb, longer HAVING 10 * count(*) >= 7 * longer)"""

_QUESTIONS = "SELECT 'raw_question' AS tab, raw_id AS id, query AS text FROM raw_question UNION ALL SELECT 'manifest', global_index::BIGINT, question FROM manifest"
_SIDES = "SELECT CASE split WHEN 'train' THEN 0 ELSE 1 END::VARCHAR AS side, global_index::BIGINT AS id, question AS text FROM manifest WHERE split IN ('train', 'validation', 'test')"


def _scalar(path: str) -> str:
    kind = f"json_type(payload, '{path}')"
    return f"CASE WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'n' || (payload->>'{path}')::DOUBLE WHEN {kind} = 'VARCHAR' THEN 's' ELSE coalesce({kind}, '') || coalesce(payload->>'{path}', '') END"


def oracle_sql() -> dict[str, str]:
    texts = ("$.query", "$.gt_ans", "$.query_id", "$.query_metadata.topic")
    line = "SELECT line_id, payload FROM raw_line WHERE payload <> '' AND json_valid(payload) AND json_type(payload) = 'OBJECT'"
    fields = " UNION ALL ".join(f"SELECT '{p}' AS tab, line_id AS id, CASE WHEN json_type(payload, '{p}') = 'VARCHAR' THEN payload->>'{p}' END AS text FROM ({line})" for p in texts)
    kinds = " || '|' || ".join(_scalar(p) for p in (*texts, "$.query_metadata.level", "$.query4test"))
    copies = "SELECT tab, keep_id, id AS copy_id FROM (SELECT tab, id, min(id) OVER (PARTITION BY tab, k) AS keep_id FROM (SELECT DISTINCT tab, id, k FROM keyed)) WHERE id <> keep_id"
    keyed = f"""keyed AS (SELECT tab, id, bare AS k FROM txt WHERE tab IN ('raw_question', 'manifest')
        UNION ALL SELECT 'raw_line', line_id, {kinds} || '|' || coalesce(string_agg(tab || '=' || bare, '|' ORDER BY tab), '') FROM ({line}) l LEFT JOIN txt ON txt.id = line_id AND tab IN ({", ".join(map(_literal, texts))}) GROUP BY line_id, payload)"""
    grams = "SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM txt WHERE tab = '{}' AND len(w) >= 12)"
    p1_found = f"""
            WITH {words_sql(f"SELECT 'manifest' AS tab, id, text FROM ({_SIDES})")}, sides AS (SELECT DISTINCT id, side FROM ({_SIDES})), {NEAR_SQL},
              same AS (SELECT a.r AS ra, b.r AS rb FROM txt a JOIN txt b ON a.bare = b.bare AND a.r < b.r),
              pairs AS (SELECT a.id AS x, b.id AS y FROM (SELECT * FROM near UNION SELECT * FROM same) JOIN txt a ON a.r = ra JOIN txt b ON b.r = rb)
            SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM pairs JOIN sides s ON s.id = x JOIN sides t ON t.id = y WHERE x <> y AND s.side <> t.side"""
    return {
        "p1_found": p1_found,
        "p1_overlap_report": f"""
            WITH pr AS ({p1_found}), ends AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM pr UNION ALL SELECT id_b FROM pr) GROUP BY 1),
              rec AS (SELECT global_index::BIGINT AS id, min(split) AS split, min(CASE WHEN contains(source_query_id, '/') THEN regexp_extract(source_query_id, '^(.*)/', 1) ELSE 'unknown' END) AS source
                      FROM manifest WHERE split IN ('validation', 'test') GROUP BY 1)
            SELECT split, source, count(*) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM rec LEFT JOIN ends USING (id) GROUP BY 1, 2""",
        "p2_groups": f"""
            WITH RECURSIVE {words_sql(_QUESTIONS)}, {NEAR_SQL}, node AS (SELECT r, tab, id, bare, tab || ':' || array_to_string(w, ' ') AS node FROM txt),
              edge AS (SELECT DISTINCT a.node AS a, b.node AS b FROM near JOIN node a ON a.r = ra JOIN node b ON b.r = rb WHERE a.bare <> b.bare), two AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
              reach AS (SELECT DISTINCT a AS n, a AS m FROM two UNION SELECT reach.n, two.b FROM reach JOIN two ON two.a = reach.m),
              member AS (SELECT tab, id, l, links FROM node JOIN (SELECT n, min(m) AS l FROM reach GROUP BY 1) ON n = node JOIN (SELECT a, count(DISTINCT b) AS links FROM two GROUP BY 1) ON a = node)
            SELECT tab, id, min(group_id) AS group_id, max(links)::BIGINT AS links FROM member JOIN (SELECT l, min(id) AS group_id FROM member GROUP BY 1) USING (l) GROUP BY 1, 2""",
        "p2_found": f"""
            WITH {words_sql(_QUESTIONS)}, {NEAR_SQL}
            SELECT DISTINCT a.tab AS tab, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM near JOIN txt a ON a.r = ra JOIN txt b ON b.r = rb WHERE a.bare <> b.bare AND a.id <> b.id""",
        "p4_found": f"""
            WITH {words_sql(_QUESTIONS)}, e AS (SELECT DISTINCT tab, id, form, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS stored FROM formed WHERE form <> '')
            SELECT DISTINCT a.tab AS tab, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM e a JOIN e b ON a.tab = b.tab AND a.form = b.form AND a.stored < b.stored WHERE a.id <> b.id""",
        "p5_found": f"WITH {words_sql(f'{_QUESTIONS} UNION ALL {fields}')}, {keyed} {copies}",
        "p5_collapsed": f"WITH {words_sql(f'{_QUESTIONS} UNION ALL {fields}')}, {keyed} SELECT tab, min(id) AS keep_id, count(DISTINCT id) AS n_copies FROM keyed GROUP BY tab, k",
        "p7_found": f"""
            WITH {words_sql("SELECT 'doc' AS tab, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM heldout_item")}, d AS ({grams.format("doc")}), i AS ({grams.format("item")})
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i USING (gram)""",
    }
