"""DuckDB text of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from pairloom.functions.text import NO_VALUE, PRIORITY_KEYS, PROMPT_ATTRIBUTES, PROMPT_DROP, PROMPT_KEYS, PROMPT_NAME, WHITE
from pairloom.operators.labelling import CATEGORY, QUESTION


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


_SOUND = "id1 IS NOT NULL AND id2 IS NOT NULL AND id1 <> id2 AND target IS NOT NULL AND NOT isnan(target) AND target BETWEEN 0 AND 1"
_UNIT = lambda salt: f"(({_h(repr(salt), 'id1', 'id2')}) % 2001 - 1000) / 1000.0::double"
_SIG = lambda x: f"CASE WHEN ({x}) >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END"

#: Views that the queries below build on; each is prefixed to the texts that name it.
VIEWS: dict[str, str] = {
    "cards": "SELECT * FROM items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS LAST) = 1",
    "weak": f"SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, max(target) AS target, round_even(max(target) * 9, 0)::int AS votes FROM matches_llm WHERE {_SOUND} GROUP BY 1, 2",
    "human": "SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, max(target) AS target, min(category) AS category, min(fold) AS fold FROM folds_v1 WHERE id1 <> id2 GROUP BY 1, 2",
    "both_cards": "SELECT id, name, category, attributes FROM items UNION ALL SELECT id, name, category, attributes FROM hardval_v1_items",
    "fps": f"""SELECT id, md5(regexp_replace(concat_ws('|', {_strip("lower(coalesce(name, 'None'))")}, {_strip("lower(coalesce(attributes, 'None'))")}, coalesce(category, 'None')), '{WHITE}+', ' ', 'g')) AS fp FROM cards""",
    "held": "SELECT DISTINCT unnest([id1, id2]) AS id FROM hardval_v1",
    "excl": f"""SELECT DISTINCT id, md5(regexp_replace(concat_ws('|', {_strip("lower(coalesce(name, 'None'))")}, {_strip("lower(coalesce(attributes, 'None'))")}, coalesce(category, 'None')), '{WHITE}+', ' ', 'g')) AS fp FROM hardval_v1_items WHERE id IN (SELECT id FROM held)""",
    "fields": """SELECT id, name, category, CASE WHEN json_valid(attributes) AND json_type(attributes) = 'OBJECT' THEN list_transform(map_entries(json_transform(attributes, '"MAP(VARCHAR, VARCHAR)"')), lambda e: {'k': e.key, 'v': coalesce(e.value, 'None')}) ELSE [] END AS raw FROM cards""",
    "entries": f"""SELECT id, name, category, list_transform(raw, lambda e: {{'k': lower({_strip('e.k')}), 'v': {_strip('e.v')}}}) AS e0 FROM fields""",
    "entries1": """SELECT id, name, category, list_transform(list_filter(list_zip(e0, range(1, len(e0) + 1)), lambda z: list_position(list_transform(e0, lambda y: y.k), z[1].k) = z[2]), lambda z: list_filter(e0, lambda y: y.k = z[1].k)[-1]) AS e FROM entries""",
    "parts": f"""SELECT id, name, category, list_concat(list_filter(list_transform({_list(PRIORITY_KEYS)}, lambda p: list_filter(e, lambda y: y.k = p AND y.v <> '' AND NOT list_contains({_list(NO_VALUE)}, lower(y.v)))[1]), lambda y: y IS NOT NULL), list_filter(e, lambda y: y.v <> '' AND NOT (list_contains({_list(PRIORITY_KEYS)}, y.k) AND NOT list_contains({_list(NO_VALUE)}, lower(y.v))))) AS p FROM entries1""",
    "text350": "SELECT id, coalesce(category, 'None') || ' | ' || coalesce(name, 'None') || ' | ' || left(array_to_string(list_transform(p, lambda y: y.k || '=' || left(y.v, 60)), '; '), 350) AS text FROM parts",
    "text500": "SELECT id, coalesce(category, 'None') || ' | ' || coalesce(name, 'None') || ' | ' || left(array_to_string(list_transform(p, lambda y: y.k || '=' || left(y.v, 60)), '; '), 500) AS text FROM parts",
    "kept": f"SELECT id, name, list_filter(raw, lambda y: {_strip('y.v')} <> '' AND NOT regexp_matches(y.k, '{PROMPT_DROP}')) AS e FROM fields",
    "prompts": f"""SELECT id, '{PROMPT_NAME}' || left(coalesce(name, 'None'), 220) || chr(10) || '{PROMPT_ATTRIBUTES}' || left(array_to_string(list_transform(list_concat(list_filter(list_transform({_list(PROMPT_KEYS)}, lambda p: list_filter(e, lambda y: y.k = p)[-1]), lambda y: y IS NOT NULL), list_filter(e, lambda y: NOT list_contains({_list(PROMPT_KEYS)}, y.k)))[1:28], lambda y: y.k || ': ' || left(y.v, 120)), '; '), 1200) AS card FROM kept""",
    "tokens": "SELECT id, list_distinct(regexp_extract_all(lower(coalesce(name, '')), '[a-zа-яё0-9]+')) AS t FROM cards",
    "sim": """SELECT w.*, CASE WHEN coalesce(len(a.t), 0) = 0 OR coalesce(len(b.t), 0) = 0 THEN -1.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double END AS jaccard FROM weak w LEFT JOIN tokens a ON a.id = w.id1 LEFT JOIN tokens b ON b.id = w.id2""",
    "logits": "SELECT *, " + ", ".join(f"0.8 * (votes - 4.5::double) + 1.5 * {_UNIT(t)} + 0.4 * {_UNIT(t + o)} AS {t}_{o}" for t in "ab" for o in ("ab", "ba")) + " FROM weak",
    "scores": "SELECT *, (a_ab + a_ba) / 2 AS a_logit, (b_ab + b_ba) / 2 AS b_logit FROM logits",
    "probs": "SELECT *, " + ", ".join(f"{_SIG(f'{t}_logit')} AS p_{t}, abs(({_SIG(f'{t}_ab')}) - ({_SIG(f'{t}_ba')})) AS gap_{t}" for t in "ab") + f", ({_h(repr('rule'), 'id1', 'id2')} % 20 = 0)::int::double AS conflict FROM scores",
    "rel": "SELECT la / (la + lb) AS ra, lb / (la + lb) AS rb, la / (la + lb) * 0.74 + lb / (la + lb) * 0.69 AS wap FROM (SELECT greatest((0.74::double - 0.1) / 0.9, 0.01) AS la, greatest((0.69::double - 0.1) / 0.9, 0.01) AS lb)",
    "merged": "SELECT p.*, r.*, r.ra * (0.05 + abs(2 * p_a - 1)) * exp(-gap_a / 0.1) AS ea, r.rb * (0.05 + abs(2 * p_b - 1)) * exp(-gap_b / 0.1) AS eb FROM probs p, rel r",
    "judged0": """SELECT *, (ea * p_a + eb * p_b) / (ea + eb) AS consensus, greatest(p_a, p_b) - least(p_a, p_b) AS spread, greatest(gap_a, gap_b) AS max_gap,
        (p_a <= 0.28 OR p_a >= 0.72)::int + (p_b <= 0.28 OR p_b >= 0.72)::int AS confident, (p_a <= 0.28 OR p_b <= 0.28) AND (p_a >= 0.72 OR p_b >= 0.72) AS conflicting,
        sqrt(ra * (p_a - (ra * p_a + rb * p_b)) ** 2 + rb * (p_b - (ra * p_a + rb * p_b)) ** 2) AS weighted_std FROM merged""",
    "scorers0": f"""SELECT *, (({_h(repr('ce'), 'id1', 'id2')}) % 901 + ({_h(repr('cx'), 'id1', 'id2')}) % 100) / 1000.0::double AS x_ab, (({_h(repr('ce'), 'id1', 'id2')}) % 901 + ({_h(repr('cxr'), 'id1', 'id2')}) % 100) / 1000.0::double AS x_r,
        (({_h(repr('ce'), 'id1', 'id2')}) % 901 + ({_h(repr('cy'), 'id1', 'id2')}) % 100) / 1000.0::double AS y_ab, (({_h(repr('ce'), 'id1', 'id2')}) % 901 + ({_h(repr('cyr'), 'id1', 'id2')}) % 100) / 1000.0::double AS y_ba FROM weak""",
    "scorers": f"""SELECT id1, id2, x_ab, x_ba, y_ab, y_ba, category, round((x_ab + x_ba) / 2, 6) AS x, round((y_ab + y_ba) / 2, 6) AS y, abs(x_ab - x_ba) AS x_gap, abs(y_ab - y_ba) AS y_gap
        FROM (SELECT z.*, c.category, CASE WHEN {_h(repr('cu'), 'id1', 'id2')} % 10 = 0 THEN 1 - x_ab ELSE x_r END AS x_ba FROM scorers0 z LEFT JOIN cards c ON c.id = z.id1)""",
    "ranks": "SELECT *, " + ", ".join(f"(rank() OVER (PARTITION BY category ORDER BY {c}) + (count(*) OVER (PARTITION BY category, {c}) - 1) / 2.0::double) / count(*) OVER (PARTITION BY category) AS rank_{c}" for c in "xy") + " FROM scorers",
    "vetoed": "SELECT j.*, r.category, r.x_gap <= 0.15 AND r.y_gap <= 0.15 AND r.rank_x >= 0.95 AND r.rank_y >= 0.95 AS high, r.x_gap <= 0.15 AND r.y_gap <= 0.15 AND r.rank_x <= 0.05 AND r.rank_y <= 0.05 AS low FROM judged0 j JOIN ranks r ON r.id1 = j.id1 AND r.id2 = j.id2",
    "judged": """SELECT *, (consensus >= 0.72)::int AS label,
        list_filter([CASE WHEN NOT (consensus >= 0.72 OR consensus <= 0.28) THEN 'consensus_uncertain' END, CASE WHEN spread > 0.25 OR conflicting THEN 'teacher_disagreement' END, CASE WHEN max_gap > 0.15 THEN 'order_instability' END,
            CASE WHEN confident < 2 THEN 'insufficient_confident_teachers' END, CASE WHEN consensus >= 0.72 AND conflict >= 0.5 THEN 'rule_positive_veto' END,
            CASE WHEN consensus <= 0.28 AND high THEN 'cross_encoder_negative_veto' END, CASE WHEN consensus >= 0.72 AND low THEN 'cross_encoder_positive_veto' END], lambda x: x IS NOT NULL) AS reasons,
        (0.25 + 0.75 * abs(2 * consensus - 1)) * (0.5 + 0.5 * least(greatest(1 - spread, 0), 1)) * exp(-max_gap / 0.1) * (0.75 + 0.25 * least(greatest((wap - 0.58) / 0.42, 0), 1)) AS quality FROM vetoed""",
    "accepted": "SELECT id1, id2, label, round(quality, 6) AS quality FROM judged WHERE len(reasons) = 0",
    "acat": "SELECT a.*, c.category FROM accepted a JOIN cards c ON c.id = a.id1 WHERE c.category IS NOT NULL",
    "wcat": "SELECT w.*, c.category FROM weak w JOIN cards c ON c.id = w.id1 WHERE c.category IS NOT NULL",
    "lab": "SELECT id1, id2, max(label) AS label, min(category) AS category FROM hardval_v1 WHERE label IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2",
    "wordsets": f"SELECT id, list_distinct(list_filter(regexp_split_to_array(text, '{WHITE}+'), lambda w: w <> '')) AS ws FROM text500",
    "scored": """SELECT l.*, round(CASE WHEN coalesce(len(a.ws), 0) = 0 OR coalesce(len(b.ws), 0) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::double END, 6) AS score FROM lab l LEFT JOIN wordsets a ON a.id = l.id1 LEFT JOIN wordsets b ON b.id = l.id2""",
    "steps": "SELECT category, score, sum(label)::double AS tp, count(*) AS n FROM scored GROUP BY 1, 2",
    "curve": "SELECT *, sum(tp) OVER w / sum(n) OVER w * tp AS part FROM steps WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
    "ap": "SELECT category, sum(n)::bigint AS n, sum(tp)::bigint AS pos, CASE WHEN sum(tp) > 0 THEN sum(part) / sum(tp) END AS ap FROM curve GROUP BY 1",
    "poslinks": "SELECT id1 AS a, id2 AS b FROM weak WHERE votes >= 8 UNION SELECT id2, id1 FROM weak WHERE votes >= 8",
    "comps": "SELECT a AS id, min(b) AS comp FROM reach GROUP BY 1",
    "sizes": "SELECT comp FROM comps GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8 AND count(*) FILTER (id IN (SELECT id FROM held)) = 0",
    "clusters": "SELECT id, comp FROM comps WHERE comp IN (SELECT comp FROM sizes)",
    "tpos": "SELECT a.id AS id1, b.id AS id2 FROM clusters a JOIN clusters b ON a.comp = b.comp AND a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM weak w WHERE w.votes >= 8 AND w.id1 = a.id AND w.id2 = b.id)",
    "tneg0": """SELECT coalesce(m1.id, w.id1) AS x, coalesce(m2.id, w.id2) AS y FROM weak w LEFT JOIN clusters c1 ON c1.id = w.id1 LEFT JOIN clusters c2 ON c2.id = w.id2 LEFT JOIN clusters m1 ON m1.comp = c1.comp LEFT JOIN clusters m2 ON m2.comp = c2.comp
        WHERE w.votes <= 1 AND (c1.comp IS NOT NULL OR c2.comp IS NOT NULL) AND c1.comp IS DISTINCT FROM c2.comp""",
    "tneg": """SELECT DISTINCT least(x, y) AS id1, greatest(x, y) AS id2 FROM tneg0 WHERE x <> y AND x NOT IN (SELECT id FROM held) AND y NOT IN (SELECT id FROM held)
        AND NOT EXISTS (SELECT 1 FROM weak w WHERE (w.votes >= 8 OR w.votes <= 1) AND w.id1 = least(x, y) AND w.id2 = greatest(x, y))""",
    "hfps": "SELECT f.id, f.fp FROM fps f WHERE f.id IN (SELECT unnest([id1, id2]) FROM human)",
    "hlinks0": "SELECT id1 AS a, id2 AS b FROM human UNION SELECT min(id) OVER (PARTITION BY fp), id FROM hfps",
    "hlinks": "SELECT a, b FROM hlinks0 WHERE a <> b UNION SELECT b, a FROM hlinks0 WHERE a <> b",
    "hcomps": "SELECT a AS id, min(b) AS comp FROM hreach GROUP BY 1",
    "cells": "SELECT s.*, c.category, CASE WHEN votes >= 8 THEN 'pos' WHEN votes <= 2 THEN 'neg' ELSE 'mid' END AS band, CASE WHEN jaccard < 0 THEN 'mid' WHEN jaccard < 0.2 THEN 'far' WHEN jaccard < 0.5 THEN 'mid' ELSE 'near' END AS jband FROM sim s JOIN cards c ON c.id = s.id1 WHERE c.category IS NOT NULL",
    "avail": "SELECT category, band, coalesce(count(*) FILTER (jband = 'far'), 0)::double AS af, coalesce(count(*) FILTER (jband = 'mid'), 0)::double AS am, coalesce(count(*) FILTER (jband = 'near'), 0)::double AS an FROM cells GROUP BY 1, 2",
    "s0": """SELECT *, CASE band WHEN 'pos' THEN 12 WHEN 'mid' THEN 4 ELSE floor(40 * (1 - 0.3::double - 0.12)) END AS budget,
        CASE WHEN af > 0 THEN CASE band WHEN 'pos' THEN 3.0 ELSE 0.5 END ELSE 0 END::double AS wf, CASE WHEN am > 0 THEN CASE band WHEN 'pos' THEN 2.0 WHEN 'mid' THEN 0.7 ELSE 1.2 END ELSE 0 END::double AS wm, CASE WHEN an > 0 THEN CASE band WHEN 'pos' THEN 1.0 WHEN 'mid' THEN 0.8 ELSE 2.5 END ELSE 0 END::double AS wn FROM avail""",
    "s1": "SELECT category, band, af, am, an, floor(budget * wf / (wf + wm + wn)) AS qf, floor(budget * wm / (wf + wm + wn)) AS qm, floor(budget * wn / (wf + wm + wn)) AS qn FROM s0",
    "first": "SELECT DISTINCT unnest([id1, id2]) AS id FROM folds_v1 WHERE fold = 0",
    "bannedfps": "SELECT fp FROM excl UNION SELECT fp FROM fps WHERE id IN (SELECT id FROM first)",
    "banned": "SELECT id FROM held WHERE id IS NOT NULL UNION SELECT id FROM fps WHERE fp IN (SELECT fp FROM bannedfps)",
    "streams0": "SELECT w.id1, w.id2, w.target, 0.3 + 0.7 * abs(2 * w.target - 1) AS weight FROM weak w WHERE abs(2 * w.target - 1) >= 0.2 AND id1 NOT IN (SELECT id FROM banned) AND id2 NOT IN (SELECT id FROM banned)",
    "xt": "SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, max(target)::double AS target FROM transitive_pairs WHERE id1 <> id2 AND target IS NOT NULL GROUP BY 1, 2",
    "xt2": "SELECT * FROM xt WHERE id1 NOT IN (SELECT id FROM banned) AND id2 NOT IN (SELECT id FROM banned)",
    "pool": """SELECT b.*, 'base' AS stream FROM streams0 b WHERE NOT EXISTS (SELECT 1 FROM xt2 x WHERE x.id1 = b.id1 AND x.id2 = b.id2) UNION ALL SELECT id1, id2, target, 1.0, 'extra' FROM xt2
        UNION ALL SELECT least(id1, id2), greatest(id1, id2), max(target)::double, 1.5, 'human' FROM folds_v1 WHERE (fold IS NULL OR fold <> 0) AND id1 <> id2 AND target IS NOT NULL AND id1 NOT IN (SELECT id FROM banned UNION SELECT id FROM first WHERE id IS NOT NULL) AND id2 NOT IN (SELECT id FROM banned UNION SELECT id FROM first WHERE id IS NOT NULL) GROUP BY 1, 2""",
}
for _i in (1, 2, 3):
    _held = {j: f"least(q{j}, a{j})" for j in "fmn"}
    _short = " + ".join(f"(q{j} - {_held[j]})" for j in "fmn")
    _room = " + ".join(f"(a{j} - {_held[j]})" for j in "fmn")
    VIEWS[f"s{_i + 1}"] = f"SELECT category, band, af, am, an, {', '.join(f'{_held[j]} + CASE WHEN {_short} > 0 AND {_room} > 0 THEN least(a{j} - {_held[j]}, floor(({_short}) * (a{j} - {_held[j]}) / ({_room}))) ELSE 0 END AS q{j}' for j in 'fmn')} FROM s{_i}"
VIEWS["quota"] = "SELECT category, band, j.jband AS jband, j.available::bigint AS available, least(j.q, j.available)::bigint AS quota FROM s4, unnest([{'jband': 'far', 'available': af, 'q': qf}, {'jband': 'mid', 'available': am, 'q': qm}, {'jband': 'near', 'available': an, 'q': qn}]) AS u(j) WHERE j.available > 0"
VIEWS["picked"] = "SELECT * FROM (SELECT c.*, q.quota, row_number() OVER (PARTITION BY c.category, c.band, c.jband ORDER BY md5(concat_ws('|', 'pool', id1, id2))) AS r FROM cells c JOIN quota q USING (category, band, jband)) WHERE r <= quota"
VIEWS["ccount"] = "SELECT category, count(*)::double AS n FROM wcat GROUP BY 1"
VIEWS["craw"] = "SELECT category, 1001.0::double * (n / sum(n) OVER ()) AS raw FROM ccount"
VIEWS["cquota"] = "SELECT category, (floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, category) <= 1001 - sum(floor(raw)) OVER ())::int)::bigint AS quota FROM craw"

#: Views that need recursion: links to follow, from the view named.
RECURSIVE = {"reach": "poslinks", "hreach": "hlinks"}

_IVAR = "1 / (least(greatest(target, 0.001), 0.999) * (1 - least(greatest(target, 0.001), 0.999)) / 9 + 1 / 36.0::double)"

TEXTS: dict[str, str] = {
    "q_scan": "SELECT * FROM transitive_pairs",
    "q_item_subset": "SELECT id, name, category FROM items WHERE id IN (SELECT unnest([id1, id2]) FROM mine_candidates)",
    "q_needed_items": "SELECT id, category FROM cards WHERE id IN (SELECT id FROM held)",
    "q_card_text": "SELECT id, text FROM text350",
    "q_prompt_card": "SELECT id, card FROM prompts",
    "q_messages": f"SELECT h.id1, h.id2, h.label, '{QUESTION[0]}' || coalesce(a.card, '') || '{QUESTION[1]}' || coalesce(b.card, '') || '{QUESTION[2]}' AS user FROM (SELECT DISTINCT * FROM hardval_v1) h LEFT JOIN prompts a ON a.id = h.id1 LEFT JOIN prompts b ON b.id = h.id2".replace("\n", "' || chr(10) || '"),
    "q_fingerprint": "SELECT id, fp FROM fps",
    "q_canonical_pairs": "SELECT least(id1, id2) AS lo, greatest(id1, id2) AS hi, target FROM transitive_pairs WHERE id1 IS NOT NULL AND id2 IS NOT NULL",
    "q_pair_keys": "SELECT DISTINCT least(id1, id2) AS lo, greatest(id1, id2) AS hi FROM matches_llm",
    "q_sigmoid": f"SELECT id1, id2, round({_SIG('a_logit')}, 6) AS p FROM scores",
    "q_platt": f"SELECT id1, id2, round({_SIG('b_logit * 0.7 - 0.2')}, 6) AS p FROM scores",
    "q_order_gap": f"SELECT id1, id2, round(abs(({_SIG('a_ab * 0.7 - 0.2')}) - ({_SIG('a_ba * 0.7 - 0.2')})), 6) AS gap FROM scores",
    "q_votes": f"SELECT id1, id2, round_even(target * 9, 0)::int AS votes FROM matches_llm WHERE {_SOUND}",
    "q_bands": "SELECT id1, id2, CASE WHEN votes >= 8 THEN 'pos' WHEN votes <= 2 THEN 'neg' ELSE 'mid' END AS band, CASE WHEN jaccard < 0 THEN 'mid' WHEN jaccard < 0.2 THEN 'far' WHEN jaccard < 0.5 THEN 'mid' ELSE 'near' END AS jband FROM sim",
    "q_confidence_weight": "SELECT id1, id2, round(abs(2 * target - 1), 6) AS confidence, round(0.3 + 0.7 * abs(2 * target - 1), 6) AS weight FROM weak",
    "q_ivar_weight": f"SELECT id1, id2, round(least(greatest(w / median(w) OVER (), 0.4), 2.0), 6) AS weight FROM (SELECT *, {_IVAR} AS w FROM weak)",
    "q_name_jaccard": "SELECT id1, id2, round(jaccard, 6) AS jaccard FROM sim",
    "q_lexical_score": """SELECT l.id1, l.id2, round(CASE WHEN coalesce(len(a.ws), 0) = 0 OR coalesce(len(b.ws), 0) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::double END, 6) AS score FROM weak l LEFT JOIN wordsets a ON a.id = l.id1 LEFT JOIN wordsets b ON b.id = l.id2""",
    "q_category_codes": "SELECT category, (dense_rank() OVER (ORDER BY category) - 1)::int AS code FROM (SELECT DISTINCT category FROM items WHERE category IS NOT NULL)",
    "q_shard": f"SELECT id1, id2, 1::bigint AS shard FROM weak WHERE {_h(repr('shard'), 'id1', 'id2')} % 4 = 1",
    "q_halves": f"SELECT id1, id2, label, {_h(repr('half'), 'id1')} % 2 AS half FROM (SELECT DISTINCT * FROM hardval_v1)",
    "q_swap_augment": f"SELECT CASE WHEN t THEN id2 ELSE id1 END AS first, CASE WHEN t THEN id1 ELSE id2 END AS second, votes FROM (SELECT *, {_h(repr('swap'), 'id1', 'id2')} % 2 = 1 AS t FROM weak)",
    "q_swap_average": "SELECT id1, id2, round((teacher_ab + teacher_ba) / 2, 6) AS mean_score FROM mine_candidates WHERE isfinite(teacher_ab) AND isfinite(teacher_ba)",
    "q_nan_clean": "SELECT id1, id2, round(CASE WHEN isnan(teacher_ab) THEN 0.5 WHEN isinf(teacher_ab) THEN (teacher_ab > 0)::int ELSE teacher_ab END, 6) AS score FROM mine_candidates",
    "q_pair_length": "SELECT h.id1, h.id2, (length(a.text) + length(b.text))::int AS length FROM (SELECT DISTINCT id1, id2 FROM hardval_v1) h JOIN text500 a ON a.id = h.id1 JOIN text500 b ON b.id = h.id2",
    "q_exclude_pairs": "SELECT id1, id2, votes FROM weak w WHERE NOT EXISTS (SELECT 1 FROM hardval_v1 h WHERE least(h.id1, h.id2) = w.id1 AND greatest(h.id1, h.id2) = w.id2)",
    "q_exclude_entities": "SELECT id1, id2, votes FROM weak WHERE id1 NOT IN (SELECT id FROM held) AND id2 NOT IN (SELECT id FROM held)",
    "q_exclude_fingerprints": "SELECT id1, id2, votes FROM weak LEFT JOIN fps a ON a.id = id1 LEFT JOIN fps b ON b.id = id2 WHERE coalesce(a.fp NOT IN (SELECT fp FROM excl), true) AND coalesce(b.fp NOT IN (SELECT fp FROM excl), true)",
    "q_purge_audit": """SELECT count(*) FILTER (p) AS by_pair, count(*) FILTER (i) AS by_id, count(*) FILTER (f) AS by_fp, count(*) FILTER (p OR i OR f) AS any_reason, count(*) AS total FROM (SELECT EXISTS (SELECT 1 FROM hardval_v1 h WHERE least(h.id1, h.id2) = w.id1 AND greatest(h.id1, h.id2) = w.id2) AS p,
        w.id1 IN (SELECT id FROM excl) OR w.id2 IN (SELECT id FROM excl) AS i, coalesce(a.fp IN (SELECT fp FROM excl), false) OR coalesce(b.fp IN (SELECT fp FROM excl), false) AS f FROM weak w LEFT JOIN fps a ON a.id = w.id1 LEFT JOIN fps b ON b.id = w.id2)""",
    "q_val_purge": "SELECT id1, id2, votes FROM weak LEFT JOIN fps a ON a.id = id1 LEFT JOIN fps b ON b.id = id2 WHERE coalesce(a.fp NOT IN (SELECT fp FROM fps WHERE id IN (SELECT unnest([id1, id2]) FROM human WHERE fold = 0)), true) AND coalesce(b.fp NOT IN (SELECT fp FROM fps WHERE id IN (SELECT unnest([id1, id2]) FROM human WHERE fold = 0)), true)",
    "q_confident": "SELECT id1, id2, (votes >= 7)::int AS label FROM weak WHERE votes <= 1 OR votes >= 7",
    "q_min_confidence": "SELECT id1, id2, votes FROM weak WHERE abs(2 * target - 1) >= 0.5",
    "q_sample_complement": "SELECT id1, id2, votes FROM weak QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', 'pre', id1, id2))) > 1000",
    "q_endpoints_present": "SELECT id1, id2, votes FROM weak WHERE id1 IN (SELECT id FROM cards) AND id2 IN (SELECT id FROM cards)",
    "q_human_val": "SELECT id1, id2, target AS label, category FROM folds_v1 WHERE fold = 0",
    "q_pair_violations": "SELECT count(*) FILTER (id1 IS NULL OR id2 IS NULL) AS null_ids, count(*) FILTER (id1 = id2) AS self_pairs, count(*) AS total FROM matches_llm",
    "q_rule_conflict": f"SELECT id1, id2, greatest(({_h(repr('r1'), 'id1', 'id2')} % 5) / 4.0::double, ({_h(repr('r2'), 'id1', 'id2')} % 3) / 2.0::double) AS conflict FROM weak",
    "q_pair_texts": "SELECT m.id1, m.id2, md5(coalesce(a.text, '')) AS m1, md5(coalesce(b.text, '')) AS m2 FROM (SELECT DISTINCT id1, id2 FROM mine_candidates) m LEFT JOIN text500 a ON a.id = m.id1 LEFT JOIN text500 b ON b.id = m.id2",
    "q_eval_join": "SELECT DISTINCT w.id1, w.id2, w.votes FROM mine_candidates m JOIN weak w ON w.id1 = least(m.id1, m.id2) AND w.id2 = greatest(m.id1, m.id2)",
    "q_align_teachers": f"SELECT id1 AS lo, id2 AS hi, round(a_logit, 6) AS logit_a, round(b_logit, 6) AS logit_b, true AS agree FROM scores WHERE {_h(repr('a'), 'id1', 'id2')} % 10 > 0 AND {_h(repr('b'), 'id1', 'id2')} % 10 > 0",
    "q_key_diff": f"SELECT count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right FROM (SELECT {_h(repr('a'), 'id1', 'id2')} % 10 > 0 AS a, {_h(repr('b'), 'id1', 'id2')} % 10 > 0 AS b FROM weak)",
    "q_override": "SELECT id1, id2, round(target, 6) AS target FROM weak w WHERE NOT EXISTS (SELECT 1 FROM xt WHERE xt.id1 = w.id1 AND xt.id2 = w.id2) UNION ALL SELECT id1, id2, target FROM xt",
    "q_pair_category": "SELECT w.id1, w.id2, c.category FROM weak w LEFT JOIN cards c ON c.id = w.id1",
    "q_category_mismatch": "SELECT count(*) FILTER (a.category <> b.category) AS crossed, count(*) FILTER (a.category IS NULL OR b.category IS NULL) AS unknown, count(*) AS total FROM weak w LEFT JOIN cards a ON a.id = w.id1 LEFT JOIN cards b ON b.id = w.id2",
    "q_pair_fingerprints": "SELECT h.id1, h.id2, a.fp AS fp1, b.fp AS fp2 FROM (SELECT DISTINCT id1, id2 FROM hardval_v1) h LEFT JOIN fps a ON a.id = h.id1 LEFT JOIN fps b ON b.id = h.id2",
    "q_ap_by_category": "SELECT category, n, pos, round(ap, 6) AS ap FROM ap",
    "q_macro_ap": "SELECT count(*) AS groups, round(avg(ap), 6) AS macro_ap FROM ap WHERE pos >= 5 AND pos < n",
    "q_macro_ap_training": "SELECT count(*) AS groups, round(avg(ap), 6) AS macro_ap FROM ap WHERE pos > 0",
    "q_accuracy": "SELECT count(*) AS total, round(avg(((a_logit > 0) = (votes >= 8))::int), 6) AS accuracy FROM scores s WHERE (votes <= 1 OR votes >= 8) AND EXISTS (SELECT 1 FROM mine_candidates m WHERE least(m.id1, m.id2) = s.id1 AND greatest(m.id1, m.id2) = s.id2)",
    "q_category_label_counts": "SELECT category, target, count(*) AS n FROM folds_v1 GROUP BY 1, 2",
    "q_fold_sizes": "SELECT fold, count(*) AS n FROM folds_v1 GROUP BY 1",
    "q_distinct_counts": "SELECT count(DISTINCT id) AS ids, count(DISTINCT fp) AS fps FROM excl",
    "q_conflicting_ids": f"SELECT id, count(*) AS versions FROM (SELECT id, name, category, attributes FROM both_cards UNION SELECT id, name, 'planted', attributes FROM both_cards WHERE {_h(repr('conflict'), 'id')} % 50 = 0) GROUP BY 1 HAVING count(*) > 1",
    "q_pool_summary": "SELECT count(*) AS n, round(avg(target), 6) AS mean_target, round(stddev_samp(target), 6) AS std_target, round(avg((votes >= 8)::int), 6) AS positive_share FROM weak",
    "q_length_percentiles": "SELECT round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.99), 6) AS p99, max(length(text))::int AS longest FROM text350",
    "q_constant_baseline": "SELECT count(*) AS groups, round(avg(share), 6) AS macro_share FROM (SELECT category, avg(label) AS share FROM (SELECT DISTINCT * FROM hardval_v1 WHERE label IS NOT NULL AND category IS NOT NULL) GROUP BY 1)",
    "q_rank01": "SELECT id1, id2, round(row_number() OVER (ORDER BY round(a_logit, 6), id1, id2) / count(*) OVER ()::double, 9) AS rank01 FROM scores",
    "q_pct_rank": "SELECT id1, id2, round((rank() OVER (PARTITION BY category ORDER BY votes) + (count(*) OVER (PARTITION BY category, votes) - 1) / 2.0::double) / count(*) OVER (PARTITION BY category), 9) AS rank FROM wcat",
    "q_rank_blend": "SELECT id1, id2, round((0.55 * (row_number() OVER (ORDER BY round(a_logit, 6), id1, id2) / count(*) OVER ()::double) + 0.45 * (row_number() OVER (ORDER BY round(b_logit, 6), id1, id2) / count(*) OVER ()::double)) / 1.0, 9) AS predict FROM scores",
    "q_dedup_items": "SELECT id, name, category, seller_id FROM cards",
    "q_duplicates": "SELECT least(id1, id2) AS lo, greatest(id1, id2) AS hi, count(*) AS copies FROM matches_llm WHERE id1 IS NOT NULL AND id2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "q_content_dups": "SELECT id1, id2 FROM weak JOIN fps a ON a.id = id1 JOIN fps b ON b.id = id2 QUALIFY row_number() OVER (PARTITION BY least(a.fp, b.fp), greatest(a.fp, b.fp) ORDER BY id1, id2) > 1",
    "q_ce_veto": "SELECT id1, id2, consensus <= 0.28 AND high AS negative_veto, consensus >= 0.72 AND low AS positive_veto FROM vetoed WHERE (consensus <= 0.28 AND high) OR (consensus >= 0.72 AND low)",
    "q_scorer_faults": f"SELECT count(*) FILTER (category IS NULL) AS no_group, 0::bigint AS x_range, count(*) FILTER ({_h(repr('f1'), 'id1', 'id2')} % 40 = 0) AS x_mean, 0::bigint AS x_order, 0::bigint AS y_range, 0::bigint AS y_mean, count(*) FILTER ({_h(repr('f2'), 'id1', 'id2')} % 30 = 0) AS y_order, count(*) AS total FROM scorers",
    "q_topk_global": "SELECT id1, id2, quality FROM accepted ORDER BY quality DESC, id1, id2 LIMIT 200",
    "q_topk_cell": "SELECT id1, id2, label, quality, category, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY quality DESC, id1, id2) AS place FROM acat) WHERE place <= 5",
    "q_sample": "SELECT id1, id2, votes FROM weak ORDER BY md5(concat_ws('|', 'sample', id1, id2)) LIMIT 500",
    "q_cap_posfrac": """SELECT id1, id2, votes FROM (SELECT *, least(nn, 800 - least(np, 280)) AS qn FROM (SELECT *, row_number() OVER (PARTITION BY target >= 0.5 ORDER BY md5(concat_ws('|', 'cap', id1, id2))) AS r, count(*) FILTER (target >= 0.5) OVER () AS np, count(*) FILTER (target < 0.5) OVER () AS nn FROM weak)) WHERE np + nn <= 800 OR r <= CASE WHEN target >= 0.5 THEN least(np, 800 - qn) ELSE qn END""",
    "q_holdout": """SELECT id1, id2, label, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key) AS r2, count(*) OVER (PARTITION BY category) AS nc, count(*) OVER () AS n FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY key) AS r, count(*) FILTER (label = 0) OVER (PARTITION BY category) AS neg
        FROM (SELECT *, (votes >= 7)::int AS label, md5(concat_ws('|', 'holdout', id1, id2)) AS key FROM wcat WHERE votes <= 1 OR votes >= 7)) WHERE label = 0 OR r <= floor(neg * 0.1::double / 0.9::double + 1e-9)) WHERE n <= 1000 OR r2 <= floor(nc * 1000 / n::double)""",
    "q_stratum_stats": "SELECT category, band, jband, available, quota FROM quota",
    "q_stratified_pool": f"SELECT id1, id2, round(least(greatest(w / median(w) OVER (), 0.4), 2.0), 6) AS sample_weight, votes, jband FROM (SELECT *, {_IVAR} AS w FROM picked)",
    "q_apportion": "SELECT category, quota FROM cquota",
    "q_cell_quota": "SELECT category, u.label, CASE WHEN u.label = 1 THEN pos ELSE quota - pos END AS quota FROM (SELECT category, quota, (quota // 2 + CASE WHEN quota % 2 = 1 AND coalesce(sum(quota % 2) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 THEN 1 ELSE 0 END)::bigint AS pos FROM cquota), (VALUES (1), (0)) AS u(label)",
    "q_select_balanced": """, srcs AS (SELECT category, count(*)::double AS n FROM vetoed WHERE category IS NOT NULL AND category IN (SELECT category FROM acat) GROUP BY 1), room AS (SELECT category, count(*) AS cap FROM acat GROUP BY 1),
        tries AS (SELECT t, category, t * (n / sum(n) OVER (PARTITION BY t)) AS raw FROM srcs, range(1, 401) AS r(t)), given AS (SELECT t, category, floor(raw) + (row_number() OVER (PARTITION BY t ORDER BY raw - floor(raw) DESC, category) <= t - sum(floor(raw)) OVER (PARTITION BY t))::int AS q FROM tries),
        best AS (SELECT max(t) AS t FROM (SELECT t FROM given JOIN room USING (category) GROUP BY 1 HAVING bool_and(q <= cap)) WHERE t <= (SELECT count(*) FROM acat))
        SELECT id1, id2, category, label FROM (SELECT a.*, g.q, row_number() OVER (PARTITION BY a.category ORDER BY quality DESC, id1, id2) AS place FROM acat a JOIN given g ON g.category = a.category AND g.t = (SELECT t FROM best)) WHERE place <= q""",
    "q_select_label_balanced": """, room AS (SELECT category, count(*) FILTER (label = 1) AS cap1, count(*) FILTER (label = 0) AS cap0 FROM acat GROUP BY 1 HAVING least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) >= 5), tries AS (SELECT t, category, t * (1.0::double / count(*) OVER (PARTITION BY t)) AS raw FROM room, range(1, 151) AS r(t)),
        given0 AS (SELECT t, category, (floor(raw) + (row_number() OVER (PARTITION BY t ORDER BY raw - floor(raw) DESC, category) <= t - sum(floor(raw)) OVER (PARTITION BY t))::int)::bigint AS q FROM tries),
        given AS (SELECT t, category, q // 2 + CASE WHEN q % 2 = 1 AND sum(q % 2) OVER (PARTITION BY t ORDER BY category) % 2 = 1 THEN 1 ELSE 0 END AS q1, q FROM given0),
        best AS (SELECT coalesce(max(t), 0) AS t FROM (SELECT t FROM given JOIN room USING (category) GROUP BY 1 HAVING bool_and(q1 <= cap1 AND q - q1 <= cap0)) WHERE t <= (SELECT count(*) FROM acat))
        SELECT id1, id2, category, label FROM (SELECT a.*, CASE WHEN label = 1 THEN q1 ELSE q - q1 END AS quota, row_number() OVER (PARTITION BY a.category, label ORDER BY quality DESC, id1, id2) AS place FROM acat a JOIN given g ON g.category = a.category AND g.t = (SELECT t FROM best)) WHERE place <= quota""",
    "q_batches": "SELECT category, ((r - 1) // 16)::bigint AS batch, count(*) AS n FROM (SELECT category, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', 'batch', id1, id2))) AS r FROM wcat) GROUP BY 1, 2",
    "q_reserve": "SELECT id1, id2 FROM accepted QUALIFY row_number() OVER (ORDER BY quality DESC, id1, id2) > 200",
    "q_training_pool": "SELECT stream, count(*) AS n, round(sum(weight), 4) AS mass, round(avg(target), 6) AS mean_target FROM pool GROUP BY 1",
    "q_stream_weights": "SELECT stream, n, round(m * (t * f / m), 4) AS mass FROM (SELECT stream, count(*) AS n, sum(weight) AS m, (SELECT count(*) FROM pool) AS t, CASE stream WHEN 'base' THEN 0.5 WHEN 'extra' THEN 0.2 ELSE 0.3 END::double AS f FROM pool GROUP BY 1)",
    "q_endpoints": "SELECT DISTINCT unnest([id1, id2]) AS id FROM (SELECT id1, id2 FROM matches_llm UNION ALL SELECT id1, id2 FROM transitive_pairs)",
    "q_leak_check": """SELECT (SELECT count(*) FROM held WHERE id IN (SELECT unnest([id1, id2]) FROM weak)) AS before, (SELECT count(*) FROM held WHERE id IN (SELECT unnest([id1, id2]) FROM weak w WHERE NOT EXISTS (SELECT 1 FROM hardval_v1 h WHERE least(h.id1, h.id2) = w.id1 AND greatest(h.id1, h.id2) = w.id2))) AS without_pairs,
        (SELECT count(*) FROM held WHERE id IN (SELECT unnest([id1, id2]) FROM weak w WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.id IN (w.id1, w.id2)))) AS without_ids""",
    "q_banned": "SELECT id, bool_or(s) AS stated, bool_or(a) AS alias FROM (SELECT id, true AS s, false AS a FROM excl UNION ALL SELECT id, false, true FROM fps WHERE fp IN (SELECT fp FROM excl)) GROUP BY 1",
    "q_components": "SELECT id, comp FROM comps",
    "q_fold_components": "SELECT id, comp FROM hcomps",
    "q_folds": f"SELECT h.id1, h.id2, c.comp, ({_h(repr('fold'), 'c.comp')} % 5)::int AS fold FROM human h JOIN hcomps c ON c.id = h.id1",
    "q_clusters": "SELECT id, comp FROM clusters",
    "q_transitive_pos": "SELECT id1, id2 FROM tpos",
    "q_transitive_neg": "SELECT id1, id2 FROM tneg",
    "q_transitive_pairs": "SELECT id1, id2, 1.0::double AS target FROM tpos UNION ALL SELECT id1, id2, 0.0 FROM tneg t WHERE NOT EXISTS (SELECT 1 FROM tpos p WHERE p.id1 = t.id1 AND p.id2 = t.id2)",
    "q_transitive_limited": """, p AS (SELECT * FROM tpos ORDER BY md5(concat_ws('|', 'closure', id1, id2)) LIMIT 100), n AS (SELECT * FROM tneg ORDER BY md5(concat_ws('|', 'closure', id1, id2)) LIMIT 300)
        SELECT id1, id2, 1.0::double AS target FROM p UNION ALL SELECT id1, id2, 0.0 FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id1 = n.id1 AND p.id2 = n.id2)""",
    "q_alias_ban": "SELECT id FROM fps WHERE fp IN (SELECT fp FROM excl)",
    "q_consensus": "SELECT id1, id2, round(consensus, 6) AS consensus, round(spread, 6) AS spread, round(max_gap, 6) AS max_gap, confident FROM judged",
    "q_consensus_stats": "SELECT id1, id2, round(weighted_std, 6) AS weighted_std, conflicting FROM judged",
    "q_consensus_accept": "SELECT id1, id2, label FROM accepted",
    "q_consensus_reasons": "SELECT id1, id2, array_to_string(reasons, ';') AS reason FROM judged",
    "q_reason_counts": "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY 1",
    "q_consensus_quality": "SELECT id1, id2, round(quality, 6) AS quality, round(least(greatest(quality, 0.2), 1.5), 6) AS sample_weight FROM judged",
    "q_consensus_adjudication": "SELECT id1, id2, array_to_string(reasons, ';') AS adjudication_reason FROM judged WHERE len(reasons) > 0",
    "q_calibration_gap": f"SELECT count(*) FILTER ({_h(repr('off'), 'id1', 'id2')} % 40 = 0) AS beyond, count(*) AS total FROM weak",
    "q_leakage": """SELECT id1, id2, reason FROM (SELECT w.id1, w.id2, concat_ws(';', CASE WHEN EXISTS (SELECT 1 FROM hardval_v1 h WHERE least(h.id1, h.id2) = w.id1 AND greatest(h.id1, h.id2) = w.id2) THEN 'excluded_exact_pair' END, CASE WHEN w.id1 IN (SELECT id FROM excl) OR w.id2 IN (SELECT id FROM excl) THEN 'excluded_item_id' END,
        CASE WHEN a.fp IN (SELECT fp FROM excl) OR b.fp IN (SELECT fp FROM excl) THEN 'excluded_item_fingerprint' END, CASE WHEN a.fp IS NOT NULL AND b.fp IS NOT NULL AND row_number() OVER (PARTITION BY least(a.fp, b.fp), greatest(a.fp, b.fp), a.fp IS NULL OR b.fp IS NULL ORDER BY w.id1, w.id2) > 1 THEN 'duplicate_content_pair' END) AS reason
        FROM weak w LEFT JOIN fps a ON a.id = w.id1 LEFT JOIN fps b ON b.id = w.id2) WHERE reason <> ''""",
    "q_contract_violations": ", stored AS (SELECT id1, id2, label, category FROM judged WHERE len(reasons) = 0), twice AS (SELECT * FROM stored UNION ALL SELECT * FROM stored WHERE "
    + f"{_h(repr('again'), 'id1', 'id2')} % 25 = 0) SELECT "
    + ", ".join(f"count(*) FILTER ({_h(repr(salt), 'id1', 'id2')} % {n} = 0) AS {c}_wrong" for c, salt, n in (("target", "t", 30), ("spread", "s", 40), ("max_gap", "g", 50), ("confident", "n", 60), ("quality", "q", 35), ("weight", "w", 45), ("label", "l", 55)))
    + """, 0::bigint AS not_acceptable, count(*) FILTER (category IS NULL) AS no_category, count(*) AS total, count(*) - count(DISTINCT (id1, id2)) AS repeated,
        (SELECT count(*) FROM stored k WHERE EXISTS (SELECT 1 FROM hardval_v1 h WHERE least(h.id1, h.id2) = k.id1 AND greatest(h.id1, h.id2) = k.id2)) AS excluded_pairs, (SELECT count(DISTINCT id) FROM excl WHERE id IN (SELECT unnest([id1, id2]) FROM stored)) AS excluded_ids FROM twice""",
    "q_exclusion_evidence": "SELECT (SELECT count(*) FROM (SELECT DISTINCT least(id1, id2), greatest(id1, id2) FROM hardval_v1 WHERE id1 IS NOT NULL AND id2 IS NOT NULL)) AS pair_keys, count(DISTINCT id) AS item_ids, count(DISTINCT fp) AS item_fingerprints, count(*) FILTER (id IS NULL) AS null_ids, count(*) FILTER (fp IS NULL OR trim(fp) = '') AS empty_fps FROM excl",
    "q_fingerprint_faults": f"SELECT count(*) FILTER (a.fp IS NULL OR b.fp IS NULL) AS missing, count(*) FILTER (a.fp IS NOT NULL AND b.fp IS NOT NULL AND {_h(repr('fp'), 'id1', 'id2')} % 20 = 0) AS mismatched, count(*) AS total FROM weak LEFT JOIN fps a ON a.id = id1 LEFT JOIN fps b ON b.id = id2",
    "q_category_faults": "SELECT count(*) FILTER (a.category <> b.category) AS crossed, count(*) FILTER (a.category IS NULL OR b.category IS NULL) AS unknown, count(*) FILTER (a.category IS NOT NULL AND b.category IS NOT NULL AND m.category IS DISTINCT FROM a.category) AS misdeclared, count(*) AS total FROM mine_candidates m LEFT JOIN cards a ON a.id = m.id1 LEFT JOIN cards b ON b.id = m.id2",
    "q_text_category": "SELECT id, split_part(text, ' | ', 1) AS category FROM text350",
    "q_numbers": "SELECT id, round(TRY_CAST(regexp_extract(name, '[0-9][0-9.,x]*') AS DOUBLE), 6) AS number FROM cards",
    "q_stored_gap": f"SELECT id1, id2, round(abs(({_SIG('(a_logit + abs(a_ab - a_ba) / 2) * 0.7 - 0.2')}) - ({_SIG('(a_logit - abs(a_ab - a_ba) / 2) * 0.7 - 0.2')})), 6) AS gap FROM scores",
    "q_human_sample": "SELECT id1, id2, target FROM human WHERE target IS NOT NULL AND (fold IS NULL OR fold <> 0) ORDER BY md5(concat_ws('|', 'human', id1, id2)) LIMIT 200",
    "q_macro_ap_labelling": "SELECT count(*) FILTER (pos > 0 AND pos < n) AS groups, round(CASE WHEN sum(n) > 100 THEN avg(ap) FILTER (pos > 0 AND pos < n) END, 6) AS macro_ap FROM ap",
    "q_answer_margin": """SELECT id1, id2, round(ln(exp(a) + exp(b)) - ln(exp(c) + exp(d)), 6) AS margin FROM (SELECT id1, id2, least(greatest(teacher_ab, -50), 50) AS a, least(greatest(teacher_ba, -50), 50) AS b, least(greatest(teacher_score, -50), 50) AS c, least(greatest(teacher_prob, -50), 50) AS d
        FROM mine_candidates WHERE isfinite(teacher_ab) AND isfinite(teacher_ba) AND isfinite(teacher_score) AND isfinite(teacher_prob))""",
    "q_prompt": f"SELECT h.id1, h.id2, h.label, h.category, md5('{CATEGORY[0]}' || h.category || '{CATEGORY[1]}' || '{QUESTION[0]}' || coalesce(a.card, '') || '{QUESTION[1]}' || coalesce(b.card, '') || '{QUESTION[2]}') AS prompt FROM (SELECT DISTINCT * FROM hardval_v1 WHERE category IS NOT NULL) h LEFT JOIN prompts a ON a.id = h.id1 LEFT JOIN prompts b ON b.id = h.id2".replace("\n", "' || chr(10) || '"),
    "q_pair_score": """SELECT p.id1, p.id2, round(len(list_intersect(coalesce(a.ws, []), coalesce(b.ws, []))) / greatest(1, len(coalesce(a.ws, [])) + len(coalesce(b.ws, [])) - len(list_intersect(coalesce(a.ws, []), coalesce(b.ws, []))))::double, 6) AS score
        FROM (SELECT DISTINCT id1, id2 FROM hardval_v1) p LEFT JOIN wordsets a ON a.id = p.id1 LEFT JOIN wordsets b ON b.id = p.id2""",
    "q_rank_loss": "SELECT p.category, count(*) AS pairs, round(avg(ln(1 + exp(n.score - p.score))), 6) AS loss FROM scored p JOIN scored n ON n.category = p.category AND p.label = 1 AND n.label = 0 GROUP BY 1",
}


def _needed(text: str, found: list[str]) -> None:
    """Views that ``text`` names, those they build on first."""
    import re

    for name in [*VIEWS, *RECURSIVE]:
        if name not in found and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
            _needed(VIEWS[name] if name in VIEWS else f"FROM {RECURSIVE[name]}", found)
            if name not in found:
                found.append(name)


def texts() -> dict[str, str]:
    """Each query's text with the views that it needs."""
    out = {}
    for name, text in TEXTS.items():
        views: list[str] = []
        _needed(text, views)
        parts = [f"{v} AS ({VIEWS[v]})" if v in VIEWS else f"{v} AS (SELECT a, a AS b FROM {RECURSIVE[v]} UNION SELECT r.a, l.b FROM {v} r JOIN {RECURSIVE[v]} l ON l.a = r.b)" for v in views]
        out[name] = ("WITH RECURSIVE " + ", ".join(parts) + ("" if text.startswith(",") else " ") if parts else "") + text
    return out
