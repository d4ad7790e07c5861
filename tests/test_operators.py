import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.operators import consensus as C
from pairloom.operators import graph as G
from pairloom.operators import metrics as M
from pairloom.operators import pairs as P
from pairloom.operators import pool as L
from pairloom.operators import quotas as Q
from pairloom.operators import scoring as R
from pairloom.operators.ranking import competition_rank, exact_quantiles, ordinal
from pairloom.operators.sampling import largest_remainder, random_key, shuffled, smallest_per_group, top_per_group

PAIRS = "id1 bigint, id2 bigint"
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def pairs(spark, rows, more=""):
    return spark.createDataFrame(rows, PAIRS + more)


def test_canonical_is_idempotent(spark):
    once = P.canonical(pairs(spark, [(2, 1), (1, 2), (3, 3)])).select(F.col("lo").alias("id1"), F.col("hi").alias("id2"))
    assert P.canonical(once).where("lo <> id1 or hi <> id2").count() == 0


def test_exclusions(spark):
    p = pairs(spark, [(2, 1), (3, 4), (5, 6), (7, None)])
    assert {tuple(r) for r in P.exclude_pairs(p, pairs(spark, [(1, 2), (6, 5)])).collect()} == {(3, 4), (7, None)}
    assert {tuple(r) for r in P.exclude_entities(p, spark.createDataFrame([(1,), (6,)], "id bigint")).collect()} == {(3, 4), (7, None)}
    assert P.exclude_pairs(p, pairs(spark, [])).count() == 4


def test_lookup_policies(spark):
    p, c = pairs(spark, [(1, 2), (1, 9)]), spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    assert P.lookup(p, c, "text", "empty").where("id2 = 9").head().text2 == ""
    assert P.lookup(p, c, "text", "drop").count() == 1
    with pytest.raises(Exception, match="catalogue lacks"):
        P.lookup(p, c, "text", "error").collect()
    with pytest.raises(ValueError):
        P.lookup(p, c, "text", "other")


def test_override(spark):
    base, extra = pairs(spark, [(1, 2, 0.0), (3, 4, 0.0)], ", target double"), pairs(spark, [(2, 1, 1.0)], ", target double")
    assert sorted(tuple(r) for r in P.override(base, extra).collect()) == [(2, 1, 1.0), (3, 4, 0.0)]


def plain_ap(rows):
    """Step sum over distinct thresholds."""
    pos, out, seen = sum(y for _, y in rows), 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        above = [y for s, y in rows if s >= t]
        out += (sum(above) - seen) / pos * sum(above) / len(above)
        seen = sum(above)
    return out


@few
@given(st.lists(st.tuples(st.sampled_from([0.1, 0.2, 0.5, 0.9]), st.integers(0, 1)), min_size=2, max_size=30).filter(lambda r: any(y for _, y in r)))
def test_average_precision(spark, rows):
    df = spark.createDataFrame([("c", s, y) for s, y in rows], "g string, s double, y int")
    assert M.average_precision(df, "g", "s", "y").head().ap == pytest.approx(plain_ap(rows))
    cubed = df.withColumn("s", F.col("s") ** 3)
    assert M.average_precision(cubed, "g", "s", "y").head().ap == pytest.approx(plain_ap(rows))


def test_constant_score_gives_prevalence_and_rules_differ(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.5, 0), ("b", 0.5, 1), ("z", 0.5, 0)], "g string, s double, y int")
    ap = M.average_precision(df, "g", "s", "y")
    assert {r.g: r.ap for r in ap.collect()} == {"a": pytest.approx(1 / 3), "b": 1.0, "z": None}
    count = lambda rule, n=1: M.macro_average_precision(ap, rule, n).head().groups
    assert (count("evaluation"), count("training"), count("labelling"), count("evaluation", 2)) == (1, 2, 1, 0)


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 9.0)], "g string, s double")
    got = sorted((r.g, r.s, r.r) for r in M.percentile_rank(df, "g", "s", "r").collect())
    assert got == [("a", 1.0, 0.25), ("a", 2.0, 0.625), ("a", 2.0, 0.625), ("a", 3.0, 1.0), ("b", 9.0, 1.0)]


def test_global_ranks(spark):
    values = [random.Random(1).randint(0, 20) / 1.0 for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(900, None), (901, float("nan"))], "id int, s double")
    at = ordinal(df.where("id < 900"), [F.col("s").desc(), F.col("id")], "at").collect()
    order = sorted(range(300), key=lambda i: (-values[i], i))
    assert {r.id: r["at"] for r in at} == {i: n + 1 for n, i in enumerate(order)}
    ranks = {r.id: r.rk for r in competition_rank(df, "s", "rk").collect()}
    assert ranks[900] is None and ranks[901] is None
    assert all(ranks[i] == 1 + sum(v > values[i] for v in values) for i in range(300))
    assert competition_rank(df.where("id < 0"), "s", "rk").count() == 0


def test_rank01_gives_nan_the_top(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.5)], "id int, s double")
    assert {r.id: r.r for r in R.rank01(df, "s", [F.col("id")], "r").collect()} == {1: pytest.approx(1 / 3), 3: pytest.approx(2 / 3), 2: 1.0}


def plain_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@few
@given(st.lists(st.tuples(st.integers(1, 25), st.integers(1, 25)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.label for r in G.pair_components(pairs(spark, edges)).collect()}
    assert got == plain_components(edges)


def test_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    random.Random(3).shuffle(chain)
    assert {r.label for r in G.pair_components(pairs(spark, chain)).collect()} == {1}


def test_closure_rules(spark):
    pos = pairs(spark, [(1, 2), (2, 3), (10, 11), *[(20, 20 + i) for i in range(1, 9)], (40, 41), (41, 42)])
    neg = pairs(spark, [(1, 3), (3, 10), (1, 99), (77, 78), (42, 99)])
    banned = spark.createDataFrame([(40,)], "id bigint")
    clusters = G.kept_clusters(G.pair_components(pos), banned)
    assert {r.id for r in clusters.collect()} == {1, 2, 3, 10, 11}  # nine cards, and a banned member, are out
    assert {tuple(r) for r in G.transitive_positives(clusters, pos).collect()} == {(1, 3)}  # although labelled negative
    got = {tuple(r) for r in G.transitive_negatives(clusters, pos, neg, banned).collect()}
    assert got == {(1, 10), (2, 10), (1, 11), (2, 11), (3, 11), (2, 99), (3, 99)}


def test_smallest_per_group_is_exact(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), F.lit(7).alias("_n")).withColumn("key", random_key("t", F.col("id"))).withColumn("quota", F.when(F.col("g") == 1, 100).otherwise(5000).cast("bigint"))
    got = {r.id for r in smallest_per_group(df, ["g"], "key", "quota").collect()}
    rows = df.collect()
    assert got == {r.id for r in rows if r.g == 0} | {r.id for r in sorted((r for r in rows if r.g == 1), key=lambda r: r.key)[:100]}
    assert smallest_per_group(df.where("id < 0"), ["g"], "key", "quota").count() == 0


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, "a1", 1), (None, "b1", 1), ("x", "c1", 1)], "g string, key string, q bigint")
    assert sorted(r.key for r in smallest_per_group(df, ["g"], "key", "q").collect()) == ["a1", "c1"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 5), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
def test_largest_remainder(parts, total):
    whole = sum(p[0] for p in parts)
    shares, floors, caps = [p[0] / whole for p in parts], [p[1] for p in parts], [p[2] for p in parts]
    got = largest_remainder(shares, total, floors, caps)
    assert all(min(f, c) <= q <= c for q, f, c in zip(got, floors, caps, strict=True))
    base = sum(min(f, c) for f, c in zip(floors, caps, strict=True))
    assert sum(got) == max(base, min(total, sum(caps)))


def test_balance_takes_the_largest_total_that_fits():
    rnd = random.Random(3)
    for _ in range(40):
        names = "abcd"[: rnd.randint(1, 4)]
        by_label = rnd.random() < 0.5
        balance = Q.Balance({c: rnd.choice([1.0, 2.0, 3.5]) for c in names}, by_label)
        cells = [(c, k) for c in names for k in ((1, 0) if by_label else (-1,))]
        capacity = {cell: rnd.randint(0, 12) for cell in cells}
        fits = [t for t in range(1, 61) if all(n <= capacity[cell] for cell, n in balance.quotas(t).items())]
        assert balance.largest(capacity, 60) == max(fits, default=0)
        assert all(sum(balance.quotas(t).values()) == t for t in range(61))


def test_select_balanced(spark):
    rows = [(i, c, y, i / 100) for i, (c, y) in enumerate([("a", 1)] * 5 + [("a", 0)] * 9 + [("b", 1)] * 4 + [("b", 0)] * 4)]
    pool = spark.createDataFrame(rows, "id1 bigint, c string, y int, q double")
    chosen, account = Q.select_balanced(pool, "c", "y", "q", ["id1"], by_label=True)
    assert account["selected"] == 17 and chosen.count() == 17
    best = [r.id1 for r in chosen.where("c = 'a' and y = 0").orderBy("id1").collect()]
    assert best == [10, 11, 12, 13]
    with pytest.raises(ValueError, match="no rows of"):
        Q.select_balanced(pool, "c", "y", "q", ["id1"], categories=["a", "b", "z"])
    with pytest.raises(ValueError, match="less than 100"):
        Q.select_balanced(pool, "c", "y", "q", ["id1"], min_output=100)
    assert Q.select_balanced(pool.where("false"), "c", "y", "q", ["id1"], min_output=0)[0].count() == 0


def test_top_per_group_breaks_ties(spark):
    rows = [(1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.9), (4, "b", 0.1), (5, None, 0.2)]
    df = spark.createDataFrame(rows, "id bigint, g string, s double").withColumn("q", F.lit(2).cast("bigint"))
    assert sorted(r.id for r in top_per_group(df, "g", "s", ["id"], "q").collect()) == [1, 3, 4, 5]


def test_shuffled_is_a_fixed_permutation(spark):
    df = spark.range(50).repartition(5)
    once, again = ([r.id for r in shuffled(x, "s", "id").collect()] for x in (df, df.repartition(3)))
    assert once == again and sorted(once) == list(range(50)) and once != sorted(once)


def judge(spark, pa, pb, ga=0.0, gb=0.0, conflict=0.0):
    df = spark.createDataFrame([(pa, pb, ga, gb, conflict)], "p_a double, p_b double, gap_a double, gap_b double, identifier_conflict double")
    two = [C.Annotator("a", 0.7, 0.1), C.Annotator("b", 0.7, 0.1)]
    return C.decide(df, two, C.ConsensusRules(), C.rule_conflict(["identifier_conflict"], df.columns)).head()


@pytest.mark.parametrize(
    ("scores", "reasons"),
    [
        ((0.9, 0.95), []), ((0.5, 0.5), ["consensus_uncertain", "insufficient_confident_teachers"]), ((0.99, 0.1), ["consensus_uncertain", "teacher_disagreement"]), ((0.9, 0.9, 0.2, 0.0), ["order_instability"]),
        ((0.9, 0.9, 0.0, 0.0, 1.0), ["rule_positive_veto"]), ((0.1, 0.1, 0.0, 0.0, 1.0), []),
    ],
)
def test_consensus_reasons(spark, scores, reasons):
    row = judge(spark, *scores)
    assert set(row.reasons) == set(reasons)
    assert row.accepted == (not row.reasons) and 0.2 <= row.sample_weight <= 1.5


def test_consensus_is_between_the_annotators(spark):
    row = judge(spark, 0.8, 0.9)
    assert 0.8 < row.consensus < 0.9 and row.spread == pytest.approx(0.1) and row.quality == pytest.approx((0.25 + 0.75 * (2 * row.consensus - 1)) * (0.5 + 0.5 * 0.9) * (0.75 + 0.25 * (0.12 / 0.42)))


def test_rules_are_checked():
    with pytest.raises(ValueError):
        C.ConsensusRules(positive=0.4)
    with pytest.raises(ValueError):
        C.ConsensusRules(order_scale=0)


def test_stream_masses(spark):
    df = spark.createDataFrame([("base", 1.0), ("base", 3.0), ("human", 5.0)], "stream string, w double")
    got = {r.stream: r.m for r in C.normalise_streams(df, "stream", "w", {"base": 0.25, "human": 0.75}).groupBy("stream").agg(F.sum("w").alias("m")).collect()}
    assert got == {"base": pytest.approx(0.75), "human": pytest.approx(2.25)}
    with pytest.raises(ValueError):
        C.normalise_streams(df, "stream", "w", {"base": 0.5, "human": 0.6})


def test_content_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "y", "x"), (3, "x", "z")], "n int, fp1 string, fp2 string")
    assert {r.n for r in C.content_duplicates(df, [F.col("n")]).where("duplicate").collect()} == {2}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "a b", "b c"), (2, None, "x"), (3, "", "")], "id int, text1 string, text2 string")
    assert {r.id: r.s for r in R.LexicalScorer().score(df, "s").collect()} == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.0}

    def load():
        return lambda a, b: [float(len(x) - len(y)) for x, y in zip(a, b, strict=True)]

    assert {r.id: r.s for r in R.swap_averaged(df, R.ModelScorer(load), "s", ["id"]).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}

    def broken():
        raise RuntimeError("no weights")

    out, failures = R.score_or_fallback(df, [R.ModelScorer(broken)], "s", lambda x: spark.createDataFrame(x.collect(), x.schema))
    assert out.count() == 3 and len(failures) == 1


def test_time_guard():
    assert R.second_pass_fits(0, 100, 780, now=110) and not R.second_pass_fits(0, 400, 780, now=410)


def test_rank_loss_equals_all_pairs(spark):
    rows = [("c", 0.9, 1), ("c", 0.2, 1), ("c", 0.4, 0), ("c", 0.9, 0), ("d", 0.1, 1)]
    got = L.rank_loss(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y").collect()
    want = [math.log1p(math.exp(n - p)) for (_, p, y), (_, n, z) in itertools.product(rows[:4], rows[:4]) if y == 1 and z == 0]
    assert [(r.g, r.pairs) for r in got] == [("c", 4)] and got[0].loss == pytest.approx(sum(want) / 4, abs=1e-6)


def test_stratum_quotas_fit(spark):
    cells = spark.createDataFrame([("c", "pos", "far", 1), ("c", "pos", "near", 50), ("c", "neg", "mid", 3)], "g string, band string, jband string, available bigint")
    got = {(r.band, r.jband): (r.available, r.quota) for r in Q.stratum_quotas(cells, "g", 40).collect()}
    assert got == {("pos", "far"): (1, 1), ("pos", "near"): (50, 11), ("neg", "mid"): (3, 3)}


def chain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(200)],
    [(1000, i) for i in range(60)] + [(7, 8), (8, 9), (5, 5)],
    [(random.Random(1).randint(0, 90), random.Random(2 * i).randint(0, 90)) for i in range(70)],
    [],
])
def test_propagate_equals_union_find(spark, links):
    df = spark.createDataFrame(links, "a bigint, b bigint")
    want = chain_components([x for x in links if x[0] != x[1]])
    assert {r.node: r.label for r in G.propagate(df).collect()} == want


def test_transitive_limits(spark):
    clusters = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(9, 2), (10, 2)], "id bigint, comp bigint")
    pos, neg = pairs(spark, [(1, 2)]), pairs(spark, [(1, 9)])
    none = spark.createDataFrame([], "id bigint")
    assert G.transitive_pairs(clusters, pos, neg, none).groupBy("target").count().orderBy("target").collect()[1]["count"] == 10
    few = {r.target: r["count"] for r in G.transitive_pairs(clusters, pos, neg, none, 3, 4).groupBy("target").count().collect()}
    assert few == {1.0: 3, 0.0: 4}


def test_banned_and_aliases(spark):
    ids = spark.createDataFrame([(1,), (7,)], "id bigint")
    fps = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id bigint, fp string")
    got = {tuple(r) for r in G.banned_and_aliases(ids, fps, fps.where("id = 1")).collect()}
    assert got == {(1, True, True), (2, False, True), (7, True, False)}


def test_align_refuses_what_differs(spark):
    schema = "lo bigint, hi bigint, p double, note string"
    tables = {"a": [(1, 2, 0.1, "x"), (1, 3, 0.2, None)], "b": [(1, 2, 0.3, "x"), (1, 3, 0.4, None)], "c": [(1, 2, 0.5, "x"), (1, 3, 0.6, None)]}
    make = lambda t: {k: spark.createDataFrame(v, schema) for k, v in t.items()}
    rows = sorted(tuple(r) for r in C.align(make(tables), ["p"], ["note"]).collect())
    assert rows == [(1, 2, "x", 0.1, 0.3, 0.5), (1, 3, None, 0.2, 0.4, 0.6)]
    for change, what in (({"c": tables["c"][:1]}, "c_missing"), ({"b": [*tables["b"], (1, 2, 0.9, "x")]}, "b_repeated"), ({"a": [(1, 2, 0.1, "other"), tables["a"][1]]}, "note_differs"), ({"a": [(1, 2, 0.1, None), tables["a"][1]]}, "note_differs")):
        with pytest.raises(ValueError, match=what):
            C.align(make(tables | change), ["p"], ["note"])
    assert C.align(make(tables | {"c": tables["c"][:1]}), ["p"], ["note"], strict=False).count() == 1


def test_rank_vetoes_reach_the_decision(spark):
    rules = C.ConsensusRules()
    two = [C.Annotator("a", 0.74, 0.1), C.Annotator("b", 0.69, 0.1)]
    rows = [(1, 0.05, 0.99, 0.0), (2, 0.95, 0.01, 0.0), (3, 0.05, 0.99, 0.3), (4, 0.95, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "id int, p_a double, rank_x double, x_gap double").withColumns({"p_b": F.col("p_a"), "gap_a": F.lit(0.0), "gap_b": F.lit(0.0)})
    got = {r.id: r.reasons for r in C.decide(df, two, rules, scorers=["x"]).collect()}
    assert got == {1: ["cross_encoder_negative_veto"], 2: ["cross_encoder_positive_veto"], 3: [], 4: []}
    assert all(r.reasons == [] for r in C.decide(df, two, rules).collect())


def test_best_by_probe(spark):
    rnd = random.Random(5)
    rows = [(x := rnd.random(), 1.0 if x > 0.6 else 0.0) for _ in range(200)]
    train = spark.createDataFrame(rows, "x double, target double")
    probe = spark.createDataFrame([("g" if i % 2 else "h", x, int(t)) for i, (x, t) in enumerate(rows)], "g string, x double, y int")
    model, probes = L.best_by_probe(train, ["x"], probe, "g", "y", [1, 20])
    assert {r.step for r in probes.collect()} == {1, 20} and max(r.macro_ap for r in probes.collect()) == pytest.approx(1.0)
    assert {r.name: r.value for r in model.collect()}["x"] > 0


def test_soft_label_model_solves_its_normal_equations(spark):
    rnd = random.Random(9)
    rows = [(rnd.random(), rnd.random()) for _ in range(300)]
    model = {r.name: r.value for r in L.soft_label_model(spark.createDataFrame(rows, "x double, target double"), ["x"]).collect()}
    gap = [1 / (1 + math.exp(-(model["intercept"] + model["x"] * x))) - t for x, t in rows]
    assert abs(sum(gap)) < 0.05 and abs(sum(g * x for g, (x, _) in zip(gap, rows, strict=True))) < 0.05


def test_rank_loss_of_rounded_scores(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([("g", rnd.random(), i % 2) for i in range(200)], "g string, s double, y int")
    exact, rounded = (L.rank_loss(df, "g", "s", "y", digits).head().loss for digits in (None, 3))
    assert abs(exact - rounded) < 1e-3


def test_exact_quantiles(spark):
    import statistics

    rnd = random.Random(2)
    for n in (1, 2, 7, 200):
        values = [rnd.choice([rnd.random(), 0.5]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        low, middle, high = exact_quantiles(df, F.col("v"), [0.0, 0.5, 1.0])
        assert (low, high) == (min(values), max(values)) and middle == pytest.approx(statistics.median(values))
    assert exact_quantiles(df.where("false"), F.col("v"), [0.5]) == [None]
