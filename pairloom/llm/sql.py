"""DuckDB text of those training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from pairloom.llm.leakage import INVISIBLE

_SOUND = "id1 IS NOT NULL AND id2 IS NOT NULL AND id1 <> id2 AND target IS NOT NULL AND NOT isnan(target) AND target BETWEEN 0 AND 1"


def _fold(x: str) -> str:
    marked = f"regexp_replace(lower({x}), '(\\d)[.,](\\d)', '\\1' || chr(2) || '\\2', 'g')"
    marked = f"regexp_replace({marked}, '(\\d)[.,](\\d)', '\\1' || chr(2) || '\\2', 'g')"
    return f"regexp_replace({marked}, '[^\\p{{L}}\\p{{N}}' || chr(2) || ']+', '', 'g')"


def _components(links: str) -> str:
    """CTEs ``reach`` and ``comps`` (node, comp) over the symmetric CTE ``links`` (a, b)."""
    return f"reach AS (SELECT a, a AS b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b), comps AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY 1)"


_RRF = " + ".join(f"coalesce(1.0::double / (60.0::double + {r}), 0.0)" for r in ("ra", "rb", "rv"))
_VISIBLE = INVISIBLE.replace("'", "''")

_KEYED = f"""WITH cards AS (SELECT id, any_value(name) AS name, any_value(category) AS category, any_value(attributes) AS attributes FROM items WHERE id IS NOT NULL GROUP BY 1),
        keyed AS (SELECT id, {_fold("coalesce(name, '')")} AS n, {_fold("coalesce(category, '')")} AS c, CASE WHEN json_valid(attributes) AND json_type(attributes) = 'OBJECT'
        THEN array_to_string(list_sort(list_distinct(list_transform(map_entries(json_transform(attributes, '"MAP(VARCHAR, VARCHAR)"')), lambda e: {_fold("e.key")} || chr(1) || {_fold("coalesce(e.value, 'null')")}))), chr(3)) ELSE coalesce(chr(4) || nullif({_fold("attributes")}, ''), '') END AS a FROM cards)"""

TEXTS: dict[str, str] = {
    "p1_found": f"""{_KEYED}
        SELECT x.id AS id1, y.id AS id2 FROM keyed x JOIN keyed y ON x.n = y.n AND x.c = y.c AND x.a = y.a AND x.id < y.id""",
    "p1_collapsed": f"{_KEYED} SELECT min(id) AS class_id, count(*) AS copies FROM keyed GROUP BY n, c, a",
    "p2_found": f"""WITH RECURSIVE nodes AS (SELECT 'c' || comp AS c, 'i' || id1 AS x, 'i' || id2 AS y, comp, fold FROM folds_v1), pairs AS (SELECT x AS a, y AS b FROM nodes UNION SELECT x, c FROM nodes WHERE comp IS NOT NULL), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), {_components("links")},
        torn AS (SELECT k.comp FROM nodes n JOIN comps k ON k.node = n.x GROUP BY 1 HAVING count(DISTINCT n.fold) > 1) SELECT DISTINCT n.comp FROM nodes n JOIN comps k ON k.node = n.x WHERE n.comp IS NOT NULL AND k.comp IN (SELECT comp FROM torn)""",
    "p2_components": f"""WITH RECURSIVE nodes AS (SELECT row_number() OVER () AS r, list_filter(['c' || comp, 'i' || id1, 'i' || id2], lambda x: x IS NOT NULL) AS n FROM folds_v1), links0 AS (SELECT n[1] AS a, unnest(n) AS b FROM nodes WHERE len(n) > 0), links AS (SELECT a, b FROM links0 UNION SELECT b, a FROM links0), {_components("links")}
        SELECT k.comp AS component, count(*) AS n, false AS torn FROM nodes x JOIN comps k ON k.node = x.n[1] GROUP BY 1""",
    "p3_found": f"""WITH RECURSIVE sure AS (SELECT DISTINCT id1, id2 FROM matches_llm WHERE {_SOUND} AND round_even(target * 9, 0) >= 8), links AS (SELECT id1 AS a, id2 AS b FROM sure UNION SELECT id2, id1 FROM sure), {_components("links")} SELECT node AS id, comp AS group_id FROM comps""",
    "p5_ranking": f"""WITH o AS (SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, CASE WHEN id1 > id2 THEN teacher_ba ELSE teacher_ab END AS ab, CASE WHEN id1 > id2 THEN teacher_ab ELSE teacher_ba END AS ba FROM mine_candidates WHERE id1 IS NOT NULL AND id2 IS NOT NULL),
        p AS (SELECT id1, id2, max(ab) FILTER (NOT isnan(ab)) AS ab, max(ba) FILTER (NOT isnan(ba)) AS ba FROM o GROUP BY 1, 2), v AS (SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, max(round_even(target * 9, 0)) AS v FROM matches_llm WHERE target BETWEEN 0 AND 1 AND NOT isnan(target) GROUP BY 1, 2),
        s AS (SELECT p.*, v.v FROM p LEFT JOIN v USING (id1, id2)), r AS (SELECT *, CASE WHEN ab IS NOT NULL THEN rank() OVER (ORDER BY ab DESC NULLS LAST) END AS ra, CASE WHEN ba IS NOT NULL THEN rank() OVER (ORDER BY ba DESC NULLS LAST) END AS rb, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v DESC NULLS LAST) END AS rv FROM s)
        SELECT id1, id2, round(f, 12) AS fused, row_number() OVER (ORDER BY f DESC, id1, id2) AS position FROM (SELECT id1, id2, {_RRF} AS f FROM r)""",
    "p7_found": f"""WITH key AS (SELECT id, min(regexp_replace(lower(category), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')) AS k FROM items WHERE id IS NOT NULL AND category IS NOT NULL GROUP BY 1),
        pairs AS (SELECT least(id1, id2) AS a, greatest(id1, id2) AS b, max(round_even(target * 9, 0)) AS v FROM matches_llm WHERE {_SOUND} GROUP BY 1, 2), pop AS (SELECT v, k FROM pairs JOIN key ON key.id = a), s AS (SELECT floor(count(*) * 0.1::double + 1e-9) AS s FROM pop)
        SELECT t.category, t.votes_from FROM sample_targets t, s WHERE (SELECT count(*) FROM pop WHERE k = regexp_replace(lower(t.category), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g') AND v BETWEEN t.votes_from AND t.votes_to) < greatest(t.min_rows::double, t.target_share * s.s)""",
    "p8_found": f"""WITH d AS (SELECT doc_id AS i, regexp_extract_all(lower(regexp_replace(text, '[{_VISIBLE}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT item_id AS i, regexp_extract_all(lower(regexp_replace(text, '[{_VISIBLE}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_passages WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT i, array_to_string(w[k:k + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(k)), pg AS (SELECT DISTINCT i, array_to_string(w[k:k + 7], ' ') AS g FROM p, unnest(range(1, len(w) - 6)) AS u(k)) SELECT DISTINCT dg.i AS doc_id, pg.i AS item_id FROM dg JOIN pg USING (g)""",
    "p9_found": """WITH d AS (SELECT lower(regexp_replace(source, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) AS src, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) AS n FROM documents), k AS (SELECT src, sum(n) AS n FROM d WHERE src IS NOT NULL AND src <> '' GROUP BY 1)
        SELECT t.source FROM mix_targets t LEFT JOIN k ON k.src = lower(regexp_replace(t.source, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) WHERE coalesce(k.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM k)""",
}
