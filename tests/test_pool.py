import pytest
from oracle import connect, same

from pairloom.operators import pool as L
from pairloom.plans import oracle

TABLES = {
    "items": "id bigint, name string, category string, attributes string, loaded_at timestamp",
    "matches_llm": "id1 bigint, id2 bigint, target double",
    "transitive_pairs": "id1 bigint, id2 bigint, target double",
    "folds_v1": "id1 bigint, id2 bigint, target int, category string, comp bigint, fold int",
    "hardval_v1": "id1 bigint, id2 bigint, label int, category string",
    "hardval_v1_items": "id bigint, name string, category string, attributes string",
}


@pytest.fixture
def folder(spark, tmp_path):
    def write(**rows):
        for name, schema in TABLES.items():
            spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_extras_are_capped_only_if_asked_for(spark, folder):
    extra = [(i, 10_000 + i, float(i % 4 == 0)) for i in range(2400)]
    d = folder(transitive_pairs=extra, matches_llm=[(i, 10_000 + i, 8 / 9) for i in range(2400)])
    count = lambda **how: {r.stream: r["count"] for r in L.training_pool(spark, d, **how).groupBy("stream").count().collect()}
    assert count() == {"extra": 2400}
    assert count(extra_limit=400) == {"extra": 400, "base": 2000}


def test_content_of_holdout_and_fold_0_is_purged_from_all_streams(spark, folder):
    card = lambda i, name: (i, name, "К", "{}", None)
    # 1, 2: holdout; 3, 4: fold 0; 11 and 12 repeat content of 1, 13 of 3; 2 is missing from the holdout's cards; 20 to 29 are free
    items = [card(1, "чай"), card(3, "кофе"), card(4, "сок"), card(11, " ЧАЙ "), card(12, "чай"), card(13, "Кофе"), *(card(i, f"вещь {i}") for i in range(20, 30))]
    clean, leaks = (20, 21), [(1, 20), (20, 11), (13, 20), (20, 3)]
    d = folder(
        items=items, hardval_v1=[(1, 2, 1, "К")], hardval_v1_items=[(1, "чай", "К", "{}")],
        matches_llm=[(a, b, 8 / 9) for a, b in [clean, *leaks]],
        transitive_pairs=[(a, b, 1.0) for a, b in [(22, 23), (24, 12), (13, 24), (2, 24), (24, 4)]],
        folds_v1=[(3, 4, 1, "К", 1, 0), (40, 41, 1, "К", 9, 0), (25, 26, 1, "К", 2, None), (27, 28, 0, "К", 3, 2), (3, 25, 1, "К", 1, 1), (40, 25, 1, "К", 9, 3), (25, 13, 1, "К", 4, None), (11, 25, 0, "К", 5, 4), (1, 26, 1, "К", 6, 1)],
    )
    got = sorted((r.stream, r.id1, r.id2) for r in L.training_pool(spark, d).collect())
    assert got == [("base", 20, 21), ("extra", 22, 23), ("human", 25, 26), ("human", 27, 28)]


def test_pool_against_its_definition(spark, sf):
    fold_0 = "SELECT unnest([id1, id2]) AS id FROM folds_v1 WHERE fold = 0"
    views = ", ".join(f"{v} AS ({oracle.VIEWS[v]})" for v in ("cards", "held", "weak", "fps", "excl", "xt"))
    text = f"""WITH {views}, first AS ({fold_0}), bad AS (SELECT id FROM held UNION SELECT id FROM fps WHERE fp IN (SELECT fp FROM excl) OR fp IN (SELECT fp FROM fps WHERE id IN (SELECT id FROM first))),
        x AS (SELECT * FROM xt WHERE id1 NOT IN (SELECT id FROM bad WHERE id IS NOT NULL) AND id2 NOT IN (SELECT id FROM bad WHERE id IS NOT NULL)),
        hb AS (SELECT id FROM bad WHERE id IS NOT NULL UNION SELECT id FROM first WHERE id IS NOT NULL)
        SELECT 'base' AS stream, id1, id2, target FROM weak w WHERE abs(2 * target - 1) >= 0.2 AND id1 NOT IN (SELECT id FROM bad WHERE id IS NOT NULL) AND id2 NOT IN (SELECT id FROM bad WHERE id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM x WHERE x.id1 = w.id1 AND x.id2 = w.id2)
        UNION ALL SELECT 'extra', id1, id2, target FROM x
        UNION ALL SELECT 'human', least(id1, id2), greatest(id1, id2), max(target)::double FROM folds_v1 WHERE (fold IS NULL OR fold <> 0) AND id1 <> id2 AND target IS NOT NULL AND id1 NOT IN (SELECT id FROM hb) AND id2 NOT IN (SELECT id FROM hb) GROUP BY 2, 3"""
    same(spark, sf, connect(sf), lambda s, d: L.training_pool(s, d).select("stream", "id1", "id2", "target"), text)
