import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairloom.llm import cards, fusion, groups, leakage, mixing, notation, overlap, products, quota, residue, splits

CARD = "id bigint, name string, category string, attributes string"


def card_table(spark, rows):
    return spark.createDataFrame(rows, CARD)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- p1


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (("Чай 2,5 л", "К", '{"a": 1, "b": "x"}'), ("чай — 2.5Л!", "к.", '{"B":"X","A":"1"}'), True),
        (("Чай 25 л", "К", "{}"), ("чай 2,5 л", "К", "{}"), False),
        (("чёрный", "К", "{}"), ("черный", "К", "{}"), False),
        (("n", "c", '{"d":{"x":1,"y":[1,2]}}'), ("N", "C", '{"D":{"y":[1,2],"x":1}}'), True),
        (("n", "c", '{"d":[1,2]}'), ("n", "c", '{"d":[2,1]}'), False),
        (("n", "c", '{"\\u0430":"\\tв"}'), ("n", "c", '{"а":"в"}'), True),
        (("n", "c", None), ("n", "c", "{}"), True),
        (("n", None, "bad"), ("n", "", "BAD!"), True),
        (("n", "c", "bad"), ("n", "c", "{}"), False),
        (("n", "c", '{"a":2.50}'), ("n", "c", '{"a":"2,5"}'), False),
    ],
)
def test_record_key(spark, a, b, same):
    assert (notation.record_key(*a) == notation.record_key(*b)) is same
    got = notation.notation_pairs(card_table(spark, [(1, *a), (2, *b)])).count()
    assert got == same


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ('{"Цвет":"Красный","цвет":"красный"}', '{"Цвет":"Красный"}'),
        ('{"вес":1.50,"цвет":"\\u0441иний"}', '{"вес":1.50,"цвет":"синий"}'),
        ('{"n":1E5,"m":"a\\/b"}', '{"m":"a/b","n":1E5}'),
        ('{"d":{"x":1,"X":1}}', '{"d":{"x":1}}'),
    ],
)
def test_copies_reach_the_key(spark, a, b):
    assert notation.record_key("n", "c", a) == notation.record_key("N!", "c", b)
    table = card_table(spark, [(1, "n", "c", a), (2, "N!", "c", b), (3, "n", "c", '{"цвет":"белый"}')])
    assert ids(notation.notation_pairs(table), "id1", "id2") == [(1, 2)]
    assert ids(notation.collapsed(table), "class_id", "copies") == [(1, 2), (3, 1)]


def spelt(rng, row):
    name, category, fields = row
    keys = list(fields)
    rng.shuffle(keys)
    name = rng.choice([str.upper, str.lower, str.title])(name).replace(" ", rng.choice([" ", "  ", " / ", ", "]))
    return name + rng.choice(["", "!", " ."]), category.upper(), json.dumps({k.upper(): f" {fields[k]} " for k in keys}, ensure_ascii=rng.random() < 0.5)


def test_notation_against_brute_force(spark):
    rng = random.Random(5)
    base = [(f"товар {i} чай", "кат", {"цвет": f"c{i % 7}", "вес, г": i % 5}) for i in range(40)]
    rows = [(n, *spelt(rng, rng.choice(base))) for n in range(160)]
    rows += [rows[0], (500, None, None, None), (501, None, None, None), (None, "x", "y", "{}")]
    keys = {r[0]: notation.record_key(*r[1:]) for r in rows if r[0] is not None}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] == keys[b])
    table = card_table(spark, rows).withColumn("inv", F.lit(1)).withColumn("class_id", F.lit("x"))
    assert ids(notation.notation_pairs(table), "id1", "id2") == want
    total = notation.collapsed(table)
    assert total.agg(F.sum("copies")).head()[0] == len(keys) and total.count() == len(set(keys.values()))
    assert notation.notation_pairs(table.where("false")).count() == 0


# ---- p2, p3


def plain_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("frontiers", [1, 12])
def test_components_against_union_find(spark, frontiers):
    rng = random.Random(frontiers)
    edges = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 200 + i) for i in range(30)]
    df = spark.createDataFrame([*edges, edges[0], (None, 3)], "a bigint, b bigint")
    want = plain_groups([e for e in edges if e[0] != e[1]])
    assert {r.node: r.label for r in groups.components(df, frontiers).collect()} == want
    assert groups.components(df.where("false")).count() == 0


def test_match_groups_count_sound_rows_only(spark):
    nan = float("nan")
    rows = [(2, 1, 8 / 9), (1, 2, 0.0), (2, 3, 0.889), (4, 5, nan), (5, 6, None), (6, 7, 1.5), (8, 8, 1.0), (9, 10, 0.83), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "id1 bigint, id2 bigint, target double")
    assert ids(groups.match_groups(df), "id", "group_id") == [(1, 1), (2, 1), (3, 1)]


FOLDS = "id1 bigint, id2 bigint, target int, category string, comp bigint, fold int"


def test_torn_comps(spark):
    rows = [(1, 2, 1, "c", 10, 0), (2, 3, 1, "c", 11, 1), (4, 5, 1, "c", 12, 2), (5, 6, 0, "c", None, 3), (7, 8, 0, "c", 13, 1), (8, 9, 0, "c", 14, None), (20, 21, 0, None, None, 0), (20, 22, 0, None, None, 1)]
    assert ids(splits.torn_comps(spark.createDataFrame(rows + rows[:2], FOLDS)), "comp") == [(10,), (11,), (12,)]
    assert splits.torn_comps(spark.createDataFrame([], FOLDS)).count() == 0


def test_splits_keep_components_and_shares(spark):
    rng = random.Random(2)
    rows = [(2 * i, 2 * i + 1 if rng.random() < 0.7 else rng.randint(1, 4000), 1, "АБВ"[i % 3], i // 2, i % 5) for i in range(2000)] + [(None, None, None, None, None, None)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.assign_splits(spark.createDataFrame(rows, FOLDS).withColumn("split", F.lit("old")), targets)[0].toPandas()
    assert len(got) == len(rows) and got.split.notna().all()
    assert got.groupby("component").split.nunique().max() == 1
    for key in ("comp", "id1"):
        assert got.dropna(subset=[key]).groupby(key).split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    for _, own in got.dropna(subset=["category"]).groupby("category"):
        assert abs((own.split == "train").mean() - 0.8) < 0.05


def test_known_splits_are_kept_and_conflicts_quarantined(spark):
    rows = [(1, 2, 1, "c", 1, 0), (3, 4, 1, "c", 2, 0), (4, 5, 1, "c", 3, 0), (9, 10, 1, "c", 4, 0)]
    nodes = spark.createDataFrame([("i1", "i1"), ("i3", "i3"), ("i33", "i3"), ("i5", "i5")], "node string, component string")
    old = spark.createDataFrame([("i1", "test", False), ("i3", "train", False), ("i5", "test", False)], "component string, split string, torn boolean")
    sizes = spark.createDataFrame([("i1", "c", 2), ("i3", "c", 3), ("i5", "c", 1)], "component string, cat string, n bigint")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double")
    done, state = splits.assign_splits(spark.createDataFrame(rows, FOLDS), targets, splits.SplitState(nodes, old, sizes))
    got = {r.id1: r.split for r in done.collect()}
    assert got[1] == "test" and got[3] is None and got[4] is None and got[9] == "train"
    assert {r.node for r in state.quarantined().collect()} == {"i3", "i33", "i4", "i5", "c2", "c3"}
    assert state.sizes.agg(F.sum("n")).head()[0] == 10 and state.nodes.select("node").distinct().count() == state.nodes.count() == 12


def test_deficits_count_all_batches(spark, tmp_path):
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    batch = lambda low, n: spark.createDataFrame([(2 * i, 2 * i + 1, 1, "c", None, 0) for i in range(low, low + n)], FOLDS)
    state = splits.SplitState(
        spark.createDataFrame([(f"i{i}", f"i{i}") for i in range(10_000, 10_400)], "node string, component string"), spark.createDataFrame([(f"i{i}", "train", False) for i in range(10_000, 10_400)], "component string, split string, torn boolean"),
        spark.createDataFrame([(f"i{i}", "c", 1) for i in range(10_000, 10_400)], "component string, cat string, n bigint"),
    )
    done, state = splits.assign_splits(batch(0, 300), targets, state)
    assert {r.split: r["count"] for r in done.groupBy("split").count().collect()} == {"test": 300}
    again = state.write(str(tmp_path / "s"))
    done, later = splits.assign_splits(batch(300, 300), targets, again)
    share = {r.split: r["count"] for r in done.groupBy("split").count().collect()}
    assert abs(share["train"] - 100) < 40 and abs(share["test"] - 200) < 40
    assert later.sizes.agg(F.sum("n")).head()[0] == 1000


def test_batches_end_in_the_components_of_all_rows(spark):
    rng = random.Random(6)
    rows = [(rng.randint(1, 400), rng.randint(1, 400), 1, "c", i // 3 if i % 2 else None, 0) for i in range(240)] + [(None, None, 1, None, None, 0)]
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double")
    df = spark.createDataFrame(rows, FOLDS)
    got, state = splits.assign_batches([df.where("id1 % 3 = 0"), df.where("id1 % 3 = 1"), df.where("id1 % 3 = 2 or id1 is null")], targets)
    whole = {r.node: r.component for r in splits.merged(splits.row_nodes(df))[0].collect()}
    assert {r.node: r.component for r in state.nodes.collect()} == whole
    assert got.count() == len(rows) and got.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


# ---- p4


def read_card(name, attributes, lexicon=None):
    tokens, *facts, kind = cards.AttributeReader().read(name, attributes)
    return cards.NameReader(lexicon or cards.Lexicon(known={"кастрюля"}, shapes={"a3 d5"})).read(" ".join(tokens), *facts, " ".join(kind))


def test_card_reader():
    ident, code, colour, dim, amount, pack = read_card("Хит продаж: Кастрюля RODA «Демеми» 0,5 л, комплект из 3, красная", '{"Торговая марка":"рода","артикул":"ХТК - 06063"}')
    assert (ident, code, colour, dim, amount, pack) == (["dememi", "roda"], "xtk06063", "red", "volume", 500.0, 3)
    assert read_card("Roda ABC-12345 Demem", None) == (["demem", "roda"], "abc12345", None, None, None, None)
    assert read_card(None, None) == ([], None, None, None, None, None)
    assert read_card("", "[1]") == ([], None, None, None, None, None)
    cut_off = read_card("Кастрюля", '{"бренд": "Рода", "серия": "demim", "цвет": "си')
    assert cut_off[0] == ["demim", "roda"] and cut_off[2] is None
    assert read_card("n", '{"цвет": "нет", "бренд": "Не указан"}')[:3] == ([], None, None)
    assert len(read_card("x" * 300_000, '{"k":"' + "y" * 300_000 + '"}')) == 6


#: Colours, codes, units and words for pieces that no list in the code has.
UNLISTED = [
    (i, f"Fabo{x} Lindo{x} кувшин", "Посуда", json.dumps({"бренд": f"fabo{x}", "серия": f"lindo{x}", "тип": "кувшин", "цвет": c, "артикул": a, "объем": "12 oz", "количество в упаковке": "3 pcs"}, ensure_ascii=False))
    for i, (x, c, a) in enumerate([("a", "золотая", "ABCD-123456"), ("b", "хаки", "AB-1234"), ("c", "золотой", "QRST-654321"), ("d", "хаки", "XY-9876")] * 2)
]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_what_no_list_names_is_learned(spark, sent):
    rows = [*UNLISTED, (50, "Fabo Lindo кувшин золотая ABCD-123456 12 oz 3 pcs", "Посуда", None), (51, "кувшин хаки AB-1234 Fabob", "Посуда", "{}"), (52, "Fabo Lindo кувщин", "Посуда", None)]
    got = {r.id: r for r in cards.read_cards(card_table(spark, rows), sent=sent).df.collect()}
    assert (got[50].ident, got[50].code, got[50].colour, got[50].dim, got[50].amount, got[50].pack) == (["fabo", "lindo"], "abcd123456", "золот", "oz", 12.0, 3)
    assert (got[51].ident, got[51].code, got[51].colour) == (["fabob"], "ab1234", "хаки")
    assert got[52].ident == ["fabo", "lindo"]  # a misspelt word of a kind is none of the article
    assert len(got) == len(rows)


def test_the_driver_holds_few_learned_words(spark, monkeypatch):
    word = lambda k: "".join("bdfgklmnpr"[int(x)] + "aeiouaeiou"[int(x)] for x in f"{k:03}")
    rows = [(k, f"Fabo Lindo кувшин {word(k // 2)} 5 {word(500 + k // 2)} 3 {word(300 + k // 2)}", "П", json.dumps({"бренд": "fabo", "тип": word(900 + k // 2), "цвет": word(k // 2), "объем": f"5 {word(500 + k // 2)}", "количество в упаковке": f"3 {word(300 + k // 2)}"}, ensure_ascii=False)) for k in range(80)]
    rows += [(100 + k, f"Fabo кувшин {w} {word(k)} {word(900 + k)[1:]} 7 {word(500 + k)} 9 {word(300 + k)}", "П", None) for k, w in enumerate(["Lindo", "x" * 70, "y" * 64] * 3)]
    rows += [(200 + k, "Fabo", "П", json.dumps({"тип": "x" * 71 if k < 2 else "y" * 65})) for k in range(4)]
    read = lambda sent: {r.id: r for r in cards.read_cards(card_table(spark, rows), sent=sent).df.collect()}
    whole, sent, plain = read(1000), [], cards._lexicon
    monkeypatch.setattr(cards, "_lexicon", lambda words: plain(sent.extend(words := list(words)) or words))
    assert read(100) == whole and (whole[100].colour, whole[100].dim, whole[100].pack) == (word(0), word(500), 9) and whole[101].ident == whole[102].ident == ["fabo", "kuvshin"]
    assert {role for role, _ in sent} <= {"shapes"}


def test_a_lexicon_is_sent_without_what_can_be_made_of_it():
    words = ["a" * 2000, *(f"слово{k}" for k in range(1000))]
    assert len(cloudpickle.dumps(cards.Lexicon(known=set(words)))) < 100_000


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.text("abc", min_size=1, max_size=7))
def test_alike_words(a, b):
    near = lambda w: {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    assert cards._alike(a, b) == bool(near(a) & near(b)) if abs(len(a) - len(b)) < 2 else not cards._alike(a, b)


PRODUCTS = [
    (1, "Roda Dememi кастрюля красная 500 мл", "Посуда", '{"бренд":"RODA","тип":"кастрюля","артикул":"ABC-12345"}'),
    (2, "кастрюлька Дедеми", "Посуда", '{"торговая марка":"Рода","серия":"dememi","объем":"0,5 л"}'),
    (3, "Кастрюля рода Dememi синяя", "Сад", '{"тип":"кастрюля"}'),
    (4, "/ кастрюля", "Посуда", '{"код товара":"АВС 12345"}'),
    (5, "Roda Kalimo кастрюля", "Посуда", '{"тип":"кастрюля"}'),
    (6, "Roda Deemmi кастрюля", "Посуда", '{"тип":"кастрюля"}'),
    (7, "товар", "Посуда", None),
    (8, "ТОВАР!", "посуда", "{}"),
    (9, None, None, None),
    (1, "Roda Dememi кастрюля красная 500 мл", "Посуда", '{"бренд":"RODA","тип":"кастрюля","артикул":"ABC-12345"}'),
    (10, "Roda Dememi кастрюля", "Посуда", '{"тип":"кастрюля"}'),
]


def test_products(spark):
    got = set(ids(products.product_pairs(card_table(spark, PRODUCTS).withColumn("code", F.lit("z"))), "id1", "id2"))
    assert {(1, 4), (1, 2), (2, 4), (1, 10), (2, 10), (7, 8), (2, 3), (3, 10)} <= got
    assert {(1, 6), (6, 10)} <= got  # two letters swapped
    assert not {(1, 3), (3, 4)} & got  # red and blue, the code's colour being red
    assert not any(5 in p or 9 in p for p in got)
    grouped = products.product_groups(card_table(spark, PRODUCTS))
    assert grouped.count() == 10 and grouped.select("id").distinct().count() == 10
    by = {r.id: r.group_id for r in grouped.collect()}
    assert by[1] == by[4] and by[5] not in (by[1], by[3])
    assert products.product_pairs(card_table(spark, [])).count() == 0


def test_prefix_join_against_brute_force(spark):
    rng = random.Random(8)
    words = [2 * i for i in range(12)]
    rows = []
    for i in range(120):
        tokens = sorted({*rng.sample(words, rng.randint(0, 4)), *([2 * rng.randint(0, 15) + 1] if rng.random() < 0.5 else [])})
        if tokens:
            rows.append((f"{i:03}", tokens, rng.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, "class string, tokens array<bigint>, colour bigint").withColumns({c: F.lit(None).cast("bigint") for c in ("dim", "amount", "pack")})
    weight = lambda s: sum(2 if t % 2 else 1 for t in s)

    def fits(a, b):
        shared = weight(set(a[1]) & set(b[1]))
        return shared >= 2 and shared >= products.CONTAINED * min(weight(a[1]), weight(b[1])) and not (a[2] and b[2] and a[2] != b[2])

    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if fits(a, b))
    assert ids(products.prefix_pairs(df), "class1", "class2") == want


def test_different_codes_of_one_brand_and_line_are_one_product(spark):
    rows = [(1, "Roda Dememi", "П", '{"артикул":"ABC-12345"}'), (2, "Dememi Roda", "П", '{"артикул":"ABD-54321"}'), (3, "Roda Kalimo", "П", '{"артикул":"ABE-11111"}')]
    assert ids(products.product_pairs(card_table(spark, rows)), "id1", "id2") == [(1, 2)]


def test_stars(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], "a string, b string")
    nodes = spark.createDataFrame([(x, 1) for x in "abcdefz"], "node string, weight int")
    got = {r.node: r.star for r in products.star_clusters(nodes, links).collect()}
    assert set(got) == set("abcdefz") and got["z"] == "z"
    near = {frozenset(x) for x in [("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")]}
    assert all(n == s or frozenset((n, s)) in near for n, s in got.items())
    assert all(got[s] == s for s in got.values())


# ---- p5


def test_fusion(spark):
    nan = float("nan")
    rows = [(1, 2, 0.9, 1000.0), (2, 1, nan, 0.1), (3, 4, 0.8, 5.0), (5, 6, None, None), (7, 8, 0.8, 5.0)]
    scores = fusion.pair_scores(spark.createDataFrame(rows, "id1 bigint, id2 bigint, teacher_ab double, teacher_ba double"), spark.createDataFrame([(2, 1, 1.0), (3, 4, nan), (1, 2, 7.0)], "id1 bigint, id2 bigint, target double"))
    by = {r.id1: r for r in scores.collect()}
    assert (by[1].ab, by[1].ba, by[1].votes) == (0.9, 1000.0, 9.0) and by[3].votes is None
    got = [(r.id1, r.position) for r in fusion.fuse(scores, ["id1", "id2"], ["ab", "ba", "votes"]).orderBy("position").collect()]
    assert got == [(1, 1), (3, 2), (7, 3), (5, 4)]
    scaled = fusion.fuse(scores.withColumn("ba", F.col("ba") ** 3), ["id1", "id2"], ["ab", "ba", "votes"])
    assert [(r.id1, r.position) for r in scaled.orderBy("position").collect()] == got
    assert fusion.fuse(scores.where("false"), ["id1", "id2"], ["ab"]).count() == 0


# ---- p6


@settings(max_examples=80, deadline=None)
@given(st.text("абвгдежз =", min_size=1, max_size=200), st.integers(0, 199), st.lists(st.text("клм", max_size=30), max_size=4))
def test_chunks_change_only_around_an_edit(text, at, others):
    at %= len(text)
    edited = text[:at] + "новое" + text[at:]
    before, after = overlap.chunks([text, *others]), overlap.chunks([*others, edited])
    assert ["".join(c) for c in before] == [text, *others] and "".join(after[-1]) == edited
    assert before[1:] == after[:-1]  # a field's chunks don't depend on the fields around it
    end, untouched = 0, 0
    for c in before[0]:
        begin, end = end, end + len(c)
        if end + overlap.WINDOW <= at or begin >= at + overlap.WINDOW:
            untouched += c not in after[-1]
    assert untouched <= 1  # but for the chunk that the edit cuts anew


def test_rolling_hash_sees_the_window_only():
    rng = random.Random(3)
    texts = ["".join(rng.choices("абвгд", k=60)) for _ in range(30)]
    shifted = [rng.choice("xyz") * 7 + t for t in texts]
    same = sum(len(set(a[1:]) - set(b)) for a, b in zip(overlap.chunks(texts), overlap.chunks(shifted), strict=True))
    assert same == 0


def test_overlaps(spark):
    a = ("Лампа Gafos Nomano 40 вт белая", '{"бренд":"Gafos","серия":"nomano","цвет":"белый","материал":"сталь","гарантия":"1 год"}')
    left = [(1, *a), (2, "лампа gafos nomano", '{"артикул":"ABC-12345"}'), (3, None, None), (4, "", "bad")]
    right = [
        (11, a[0].upper() + "!", '{"серия":"nomano","бренд":"GAFOS","цвет":"белый","материал":"сталь","сезон":"лето"}'),
        (12, a[0].replace("белая", "красная"), a[1].replace("белый", "красный")),
        (13, "Чайник Rinex Popata", '{"бренд":"Rinex","материал":"сталь","гарантия":"1 год"}'),
        (14, "лампа gafos nomano новая", '{"артикул":"abc12345"}'),
        (15, None, None),
    ]
    table = lambda rows: spark.createDataFrame(rows, "id bigint, name string, attributes string")
    assert ids(overlap.overlaps(table(left), table(right)), "id1", "id2") == [(1, 11), (2, 14)]
    assert overlap.overlaps(table([]), table(right)).count() == 0


def test_cards_of_other_brands_are_no_candidates(spark):
    same = {"материал": "сталь", "гарантия": "1 год", "сезон": "лето", "страна": "республика далёкая северная приморская", "примечание": "хранить в сухом тёмном месте вдали от печи"}
    brands = ["gafosia", "rinexul", "popatem", "dulbako", "zumitre", "wekchon"]
    row = lambda i, w: (i, f"Лампа {w}", json.dumps({"бренд": w, "серия": w[::-1], **same}, ensure_ascii=False))
    left, right = [row(k, w) for k, w in enumerate(brands)], [row(50 + k, w) for k, w in enumerate([*brands, "gafosai"])]
    rows = [(1, *r) for r in left] + [(2, *r) for r in right]
    both = overlap.chunked(spark.createDataFrame(rows, "side int, id bigint, name string, attributes string"))
    rarity = both.select("side", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("df"), F.count_distinct("side").alias("k")).where("k = 2").drop("k")
    met = ids(overlap.candidates(both.where("side = 1"), both.where("side = 2"), rarity), "id1", "id2")
    assert met == sorted([(k, 50 + k) for k in range(len(brands))] + [(0, 56)])
    table = lambda rows: spark.createDataFrame(rows, "id bigint, name string, attributes string")
    assert ids(overlap.overlaps(table(left), table(right)), "id1", "id2") == met


def test_overlaps_of_long_names_meet_by_their_last_words(spark):
    long = lambda tag: " ".join(f"{tag}{x}{x}a" for x in "bcdfghjklmnpq")
    same = json.dumps({"материал": "сталь", "гарантия": "1 год", "сезон": "лето", "страна": "республика далёкая северная приморская", "примечание": "хранить в сухом тёмном месте вдали от печи"}, ensure_ascii=False)
    other = lambda i: [(i, f"zzgafosia zznomanex {long('ab')} вт", same)]
    short = lambda i: [(i, "zzgafosia zznomanex прибор", same)]
    table = lambda rows: spark.createDataFrame(rows, "id bigint, name string, attributes string")
    plain = [(50 + i, f"zzgafosia prost{x}rok", "{}") for i, x in enumerate("bcd")]
    unlike = [(60, f"zzgafosia {long('af')}", "{}")]
    for a, b in ((other(1), short(2)), (short(1), other(2)), (other(1), [(2, f"zzgafosia zznomanex {long('ac')} вт", other(2)[0][2])])):
        got = overlap.overlaps(table([*a, *plain]), table([*b, *unlike]))
        assert (1, 2) in ids(got, "id1", "id2")
        assert all(r.id2 != 60 for r in got.collect())


def test_found_pairs_have_the_smaller_id_first(spark, sf):
    from pairloom.llm import queries

    found = queries.p6_found(spark, "/root/testdata/sf0.01").collect()
    assert found and all(r.id1 <= r.id2 for r in found) and len(found) == len({tuple(r) for r in found})


def test_overlaps_against_brute_force(spark, sf):
    """All pairs of the cards of both sides, by the shares of chunks and the checks stated in the docstring."""
    d = "/root/testdata/sf0.01/"
    t = {n: spark.read.parquet(f"{d}{n}.parquet") for n in ("hardval_v1", "hardval_v1_items", "transitive_pairs", "items")}
    left, right = overlap.cards_of(overlap.pair_ids(t["hardval_v1"]), t["hardval_v1_items"], t["items"]), overlap.cards_of(overlap.pair_ids(t["transitive_pairs"]), t["items"])
    sided = left.select(F.lit(1).alias("side"), "*").unionByName(right.select(F.lit(2).alias("side"), "*"))
    rows = overlap.chunked(sided).select("side", "id", "chunks", "sizes", "names", "ident", "facts").collect()
    a, b = [r for r in rows if r.side == 1 and r.chunks], [r for r in rows if r.side == 2 and r.chunks]
    clash = lambda x, y, k: x[k] is not None and y[k] is not None and x[k] != y[k]

    def near(x, y):
        f, g = x.facts, y.facts
        if any(clash(f, g, k) for k in ("code", "colour", "pack")) or (clash(f, g, "amount") and not clash(f, g, "dim")):
            return False
        shared = sum({c: s for c, s in zip(x.chunks, x.sizes, strict=True)}[c] for c in set(x.chunks) & set(y.chunks))
        low = min(shared / sum(x.sizes), shared / sum(y.sizes))
        alike = sum(2 if n % 2 else 1 for n in set(x.names) & set(y.names)) >= 2
        return low >= overlap.NEAR or (alike and low >= overlap.NEAR_NAMED)

    got = set(ids(overlap.overlaps(left, right), "id1", "id2"))
    want = {(x.id, y.id) for x in a for y in b if x.id != y.id and near(x, y)}
    assert got <= want and len(want - got) <= 0.02 * len(want)  # the rest have no brand or line word in common


def test_leaked_cards_include_equal_ids(spark):
    pair = "id1 bigint, id2 bigint"
    items = card_table(spark, [(1, "a", "c", "{}"), (5, "Лампа Gafos Nomano", "c", "{}"), (6, "лампа «Gafos» Nomano", "c", None)]).withColumn("rank", F.lit(3))
    got = overlap.leaked_cards(spark.createDataFrame([(1, 5)], pair), card_table(spark, []), spark.createDataFrame([(6, 1), (None, 77)], pair), items)
    assert ids(got, "id1", "id2") == [(1, 1), (5, 6)]


# ---- p7


def test_quota(spark):
    nan = float("nan")
    matches = [(i, 1000 + i, (i % 10) / 9) for i in range(1, 201)] + [(2, 1, nan), (3, 3, 1.0), (1001, 1, 1.0), (500, 501, 1.0)]
    items = [(i, "Чай, кофе" if i % 4 else "сад") for i in range(1, 300)] + [(1, "ЧАЙ  КОФЕ."), (400, None)]
    targets = [("Чай, кофе", 0, 1, 0.5, 2), ("Чай, кофе", 2, 9, 0.3, 2), ("Сад", 0, 9, 0.15, 30), ("Нет", 0, 9, 0.05, 1)]
    m, i = spark.createDataFrame(matches, "id1 bigint, id2 bigint, target double"), spark.createDataFrame(items, "id bigint, category string")
    t = spark.createDataFrame(targets, "category string, votes_from int, votes_to int, target_share double, min_rows bigint")
    assert ids(quota.shortfalls(m, i, t), "category", "votes_from") == [("Нет", 0)]
    sample = quota.quota_sample(m, i, t).toPandas()
    assert not sample.duplicated(["id1", "id2"]).any()
    counts = sample.groupby(["category", "votes_from"]).size().to_dict()
    assert counts[("Сад", 0)] == 30 and counts[("Чай, кофе", 0)] >= 2 and counts[("Чай, кофе", 2)] >= 2
    assert quota.quota_sample(m.where("false"), i, t).count() == 0


# ---- p8


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"слово{i}" for i in range(400)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 60))), "t") for i in range(30)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 2:
            source = rng.choice(texts)[1].split()
            start, n = rng.randint(0, len(source) - 1), rng.choice([6, 7, 8, 9, 20])
            words[len(words) // 2 : len(words) // 2] = [w.upper() + rng.choice([",", "", " —"]) for w in source[start : start + n]]
        docs.append((i, " ".join(words).replace("слово1", "сло​во1")))
    docs += [(900, None), (901, ""), (902, "x " * 100_000)]
    grams = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    want = sorted((d, i) for d, t in docs for i, p, _ in texts if grams(leakage.words_of(t)) & grams(leakage.words_of(p)))
    table, passages = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*texts, (99, None, "t"), (98, "а б", "t")], "item_id bigint, text string, task string")
    got = leakage.leaks(table, passages, paraphrases=True)
    assert ids(got.where("verbatim"), "doc_id", "item_id") == want and len(want) > 15
    report = leakage.leak_report(got, passages)
    assert report.count() == 32 and report.agg(F.sum("verbatim")).head()[0] == len(want)
    assert leakage.leaks(table, passages.where("false")).count() == 0


def test_paraphrases_with_words_replaced(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(f"p{i}w{k}" if k % 2 else f"общее{rng.randint(0, 20)}" for k in range(16 + i)), "t") for i in range(12)] + [(50, "а б в г д", "t")]
    replaced = lambda text, n: " ".join(f"иное{k}" if k % n == n - 1 else w for k, w in enumerate(text.split()))
    docs = [(100 * n + i, "начало " * rng.randint(0, 30) + replaced(t, n) + " конец" * rng.randint(0, 30)) for i, t, _ in texts[:-1] for n in (2, 3, 4)]
    docs += [(900, " ".join(reversed(texts[0][1].split()))), (901, "а б в г ж"), (902, None), (903, texts[1][1].replace(" ", " x "))]

    def plain_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, r=row, x=x: r[j - 1] + 1 if x == b[j - 1] else max(left, r[j]), initial=0))
        return row[-1]

    kept = lambda t, p: plain_lcs(leakage.words_of(p), leakage.words_of(t)) / len(leakage.words_of(p))
    want = sorted((d, i) for d, t in docs for i, p, _ in texts[:-1] if kept(t, p) >= leakage.PARAPHRASE)
    assert {(100 * n + i, i) for i, _, _ in texts[:-1] for n in (3, 4)} | {(903, 1)} <= set(want)
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(texts, "item_id bigint, text string, task string"), paraphrases=True)
    assert ids(got, "doc_id", "item_id") == want and got.where("verbatim").count() == 0


def test_templates_without_the_answer_are_no_paraphrase(spark):
    shared = "сколько упаковок уместит стеллаж если товар занимает место на складе у стены".split()
    texts = [(i, " ".join([*shared, *(f"имя{i}н{k}" for k in range(4))]), "t") for i in range(3)]
    docs = [(1, " ".join([w if k % 7 != 6 else "зачем" for k, w in enumerate(shared)])), (2, " ".join([*(w if k % 7 != 6 else "зачем" for k, w in enumerate(shared)), "имя0н0", "имя0н1", "имя0н2"]))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(texts, "item_id bigint, text string, task string"), paraphrases=True)
    assert ids(got, "doc_id", "item_id") == [(2, 0)]


def test_runs_that_the_latent_search_misses_are_met(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MIN_COSINE", 2.0)
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(12)), "t") for i in range(3)]
    docs = spark.createDataFrame([(i, f"начало {t} конец") for i, t, _ in texts], "doc_id bigint, text string")
    got = leakage.leaks(docs, spark.createDataFrame(texts, "item_id bigint, text string, task string"))
    assert ids(got.where("not latent"), "doc_id", "item_id") == [(i, i) for i in range(3)]


def test_latent_search_proposes_most_leaks(spark):
    d = "/root/testdata/sf0.1/"
    found = leakage.leaks(spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "eval_passages.parquet"))
    total, latent = found.agg(F.count(F.lit(1)), F.count_if("latent")).head()
    assert total > 500 and latent >= 0.9 * total


def test_blocks_of_passages(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 2)
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(12)), "t") for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    assert ids(leakage.leaks(docs, spark.createDataFrame(texts, "item_id bigint, text string, task string")), "doc_id", "item_id") == [(i, i) for i in range(5)]


def test_basis_holds_the_rows(spark):
    rows = [(["a", "b"],), (["b", "c"],), (["d"],)]
    idf = dict.fromkeys("abcd", 1.0)
    slots = {w: leakage._slot(w) for w in idf}
    basis = leakage.latent_basis(spark.createDataFrame(rows, "words array<string>"), idf, slots, rank=8)
    dense = leakage._dense([r[0] for r in rows], idf, slots)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-3)


# ---- p9


def test_rake_meets_marginals():
    cells = {("a", "x", "t"): 100.0, ("a", "y", "t"): 50.0, ("b", "x", "t"): 80.0, ("b", "y", "t"): 70.0}
    weights, converged = mixing.rake(cells, [{"a": 120.0, "b": 180.0}, {"x": 170.0, "y": 130.0}, {"t": 300.0}], [9.0] * 4)
    assert converged
    size = lambda axis, part: sum(w * cells[k] for k, w in weights.items() if k[axis] == part)
    assert size(0, "a") == pytest.approx(120, rel=1e-3) and size(1, "y") == pytest.approx(130, rel=1e-3)


def test_mix(spark):
    docs = [(i, "слово и дело " * (1 + i % 3), "ru" if i % 2 else "EN", [" Web", "app", "rare", None][i % 4] if i < 300 else "rare ", None if i % 5 else i) for i in range(310)]
    df = spark.createDataFrame([*docs, (900, None, None, "web", None), (901, "", "de", "app", None)], "doc_id bigint, text string, lang string, source string, item_id bigint")
    items = spark.createDataFrame([(5, "Сад"), (10, None)], "id bigint, category string")
    targets = spark.createDataFrame([("web", 0.3, 2), ("app", 0.2, 1), ("rare", 0.5, 1), ("none", 0.01, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(df, items, targets)
    assert {r.source for r in mix.plan.where("short").collect()} == {"rare", "none"}
    drawn = mix.drawn.toPandas()
    assert drawn[drawn.src == "rare"].repeats.max() == 1 and drawn[drawn.src == "web"].repeats.max() <= 2
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["none"].drawn_tokens == 0 and sum(r.share for r in shares.values()) == pytest.approx(1)
    assert shares["web"].drawn_tokens / mix.total == pytest.approx(0.3, abs=0.06)
    assert mixing.Mix(df.where("false"), items, targets).shares().count() == 4
    axes = {(r.axis, r.part): r for r in mix.marginals().collect()}
    assert axes[("source", "web")].drawn == shares["web"].drawn_tokens and {a for a, _ in axes} == {"source", "language", "topic"}


# ---- p10


@pytest.mark.parametrize(("text", "shown"), [("Цвет {{ЦВЕТ} тут", True), ("у %(price)s руб", True), ("#BRAND# и", True), ("поля [А], [Б]", False), ("Набор {4 шт.} тут", False), ("<5 вариантов или >1", False), ("стал undefined тоньше", True), ("undefined is not a function", False), ("100% хлопок и 19%", False), ("[НАЗВАНИЕ ТОВАРА]", True), ("цена в $ и рублях", False)])
def test_slots(text, shown):
    assert residue.slot(text) is shown


def test_residue_on_held_out_sources_and_notations(spark, sf):
    report = {r.kind: r for r in residue.validation_report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    assert report["slot"].recall > 0.9 and report["slot"].precision > 0.9 and report["message"].recall > 0.8 and report["message"].precision > 0.8
    assert report["notation"].recall > 0.4


def test_residue_cases(spark):
    content = ["Пользуемся на балконе, претензий нет. Материал крепкий, шов ровный.", "Короб надёжный, углы целые, доставили быстро.", "Открытка называется «Страница не найдена», бумага плотная. Шов ровный, материал крепкий."]
    bad = ["Please enable JavaScript to view this page", "502 Bad Gateway | Сервис временно недоступен", "lorem ipsum lorem ipsum"]
    rows = [(i, content[i % 2], "s") for i in range(40)] + [(100 + i, bad[i % 3], "s") for i in range(30)] + [(200, content[2], None), (201, f"{content[0]} Цвет {{{{color}}}} хороший.", None), (202, None, None), (203, " ", None), (204, "ok " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("found", F.lit("x"))
    found = {r.doc_id for r in residue.residue_scores(df).where("found").collect()}
    assert {100, 101, 102, 201} <= found and not {0, 1, 200, 202, 203} & found
    assert residue.residue_scores(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["{{ title | default: %s}}", "{%% if %s%%}", "<%% %s%%>", "${%s}", "<<%s>>", "&lt;%s&gt;", "<укажите %s>", "[[%s]]", "[вставить %s]", "[your %s]"])
def test_slots_of_any_length(text):
    assert residue.slot(text % ("очень длинно " * 20))


def test_slots_of_unlisted_notation_are_found_by_score(spark):
    content = ["Пользуемся на балконе, претензий нет.", "Набор {4 шт.} тут, 100% хлопок.", "Поля [А] и [Б], цена < 5."]
    slots = [f"{a} {{{{{n}}}}} {b}" for n in ("color", "name", "title", "size", "price") for a, b in (("Цвет", "хороший."), ("Бренд", "радует."))] + [f"Цена {{{n}}} тут." for n in ("price", "cost", "name")]
    rows = [(i, content[i % 3], "s") for i in range(90)] + [(100 + i, slots[i % len(slots)], "s") for i in range(60)] + [(200, "Цвет {{product.title тут.", "s"), (201, "Цена {product.title} тут.", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    train = df.where("doc_id < 200")
    assert not any(residue.slot(r[1]) for r in rows[-2:])
    model, _ = residue.fit(train)
    best = model.judge([r[1] for r in rows], residue.Hashed())[1]
    assert [x >= residue.SLOT for x in best] == [r[0] >= 100 for r in rows]


def test_scores_of_a_batch_are_those_of_each_text(spark):
    texts = ["Цвет {{color}} хороший.", "502 Bad Gateway", "Шов ровный, материал крепкий.", "", "да " * 3000]
    model, _ = residue.fit(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts * 5)], "doc_id bigint, text string, source string"))
    whole = model.judge(texts, residue.Hashed())
    alone = [model.judge([t], residue.Hashed()) for t in texts]
    assert np.allclose(whole[0], [a[0][0] for a in alone]) and np.allclose(whole[1], [a[1][0] for a in alone])


# ---- queries


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 7, 8, 9, 10)} | {"p5_ranking"} <= names


def test_texts_match(spark, sf):
    from oracle import connect, same

    from pairloom.llm import queries

    con = connect(sf)
    for name, text in queries.oracle_sql().items():
        same(spark, sf, con, queries.queries()[name], text)
