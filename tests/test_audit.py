import pytest
from pyspark.sql import functions as F

from pairloom.functions import scores as S
from pairloom.functions import text as T
from pairloom.operators import audit as A
from pairloom.operators import consensus as C
from pairloom.operators import labelling as B
from pairloom.operators import pairs as P
from pairloom.operators import scoring as R

RULES = C.ConsensusRules()
TWO = [C.Annotator("a", 0.74, 0.1), C.Annotator("b", 0.69, 0.1)]


def report(**changes):
    cuts = {"negative_threshold": RULES.negative, "positive_threshold": RULES.positive}
    return {
        "passed": True, "bidirectional": True, "no_tokenizer_truncation": True, "calibration_evaluation_disjoint": True, "model": "m", "teacher_macro_ap": 0.7, "teacher_macro_ap_constant": 0.1, "prompt_contract_sha256": "a" * 64,
        "yes_token_id": 5, "no_token_id": 6, "heldout_decision_audit": cuts, "hard_negative_audit": cuts, "component_halves": {"0": {"delta": 0.0}, "1": {"delta": 0.1}},
        "calibration": {"fit_role": "calibration", "fit_stratum": "representative", "slope": 0.7, "intercept": -0.2, "rows": 500, "reference_positive_prior": 0.3},
    } | changes


def test_gate_faults():
    assert A.gate_faults(report(), A.GateRules(), RULES) == []
    for changes in (
        {"passed": False}, {"model": " "}, {"teacher_macro_ap": 0.3}, {"teacher_macro_ap": "no"}, {"prompt_contract_sha256": "x"}, {"teacher_macro_ap_constant": 0.9}, {"component_halves": {"0": {"delta": -0.1}}},
        {"hard_negative_audit": {"negative_threshold": 0.1, "positive_threshold": 0.9}}, {"calibration": {}}, {"calibration": None},
    ):
        assert A.gate_faults(report(**changes), A.GateRules(), RULES), changes


def test_metadata_faults():
    meta = {"model": "m", "prompt_contract_sha256": "a" * 64, "yes_token_id": 5, "no_token_id": 6, "tokenizer_truncation": False, "bidirectional": True, "probability_calibration": {"slope": 0.7, "intercept": -0.2}}
    assert A.metadata_faults(meta, report()) == []
    for k, v in (("model", "n"), ("tokenizer_truncation", None), ("bidirectional", False), ("probability_calibration", {"slope": 0.8, "intercept": -0.2})):
        assert len(A.metadata_faults(meta | {k: v}, report())) == 1


def scored(spark, rows):
    return spark.createDataFrame(rows, "id1 bigint, id2 bigint, p_a double, p_b double, gap_a double, gap_b double")


def test_audit_counts(spark):
    judged = C.decide(scored(spark, [(1, 2, 0.95, 0.9, 0.0, 0.01), (3, 4, 0.5, 0.5, 0.0, 0.0)]), TWO, RULES)
    sources = {n: {"model": n, "score_sha256": n, "gate_sha256": n} for n in "ab"}
    audit = A.consensus_audit(judged, TWO, RULES, {"pair_keys": 1}, sources)
    assert audit["counts"]["rows"] == 2 and audit["counts"]["accepted_rows"] == 1 and audit["labels"] == {"1": 1}
    assert audit["reasons"]["consensus_uncertain"] == 1 and audit["independent_annotators"] == 2
    assert not A.consensus_audit(judged, TWO, RULES, {}, {n: {"model": "same", "score_sha256": n, "gate_sha256": n} for n in "ab"})["independent"]
    with pytest.raises(ValueError):
        A.consensus_audit(judged, TWO, RULES, {}, {"a": {}})


def test_contract_faults(spark):
    judged = C.decide(scored(spark, [(1, 2, 0.95, 0.9, 0.0, 0.01), (3, 4, 0.05, 0.02, 0.0, 0.0)]), TWO, RULES)
    stored = judged.withColumn("target", F.col("consensus")).withColumn("category", F.lit("c"))
    clean = A.contract_faults(stored, TWO, RULES).head().asDict()
    assert clean.pop("total") == 2 and not any(clean.values())
    wrong = stored.withColumn("quality", F.lit(None).cast("double")).withColumn("label", 1 - F.col("label")).unionByName(stored)
    found = A.contract_faults(wrong, TWO, RULES, spark.createDataFrame([(2, 1)], "id1 bigint, id2 bigint"), spark.createDataFrame([(4,)], "id bigint")).head()
    assert (found.quality_wrong, found.label_wrong, found.repeated, found.excluded_pairs, found.excluded_ids) == (2, 2, 2, 1, 1)


def test_exclusion_files(spark, tmp_path):
    pairs, items = str(tmp_path / "p"), str(tmp_path / "i")
    spark.createDataFrame([(2, 1), (1, 2), (None, 3)], "id1 bigint, id2 bigint").coalesce(1).write.parquet(pairs)
    spark.createDataFrame([(1, "x"), (2, "x")], "id bigint, fp string").coalesce(1).write.parquet(items)
    found = A.exclusion_files(spark, [pairs], [items])
    assert (found["pair_keys"], found["item_ids"], found["item_fingerprints"]) == (1, 2, 1) and all(len(x) == 64 for x in found["pair_files"] + found["item_files"])
    spark.createDataFrame([(1, " ")], "id bigint, fp string").write.mode("overwrite").parquet(items)
    with pytest.raises(ValueError, match="incomplete"):
        A.exclusion_files(spark, [pairs], [items])


def test_answers():
    encode = lambda text: [ord(c) for c in text]
    assert B.answer_tokens(encode, ["да", "Да", "д", ""]) == sorted({ord("д"), ord("Д")})
    assert B.exact_answers(lambda w: [len(w)] if w in ("да", "нет") else [0] * len(w)) == (2, 3)
    with pytest.raises(ValueError):
        B.exact_answers(encode)
    with pytest.raises(ValueError, match="merges"):
        B.exact_answers(lambda w: [len(w)], prompt="x")


def test_answer_margin(spark):
    import math

    row = spark.createDataFrame([([1.0, 800.0, -3.0, 799.0],)], "l array<double>").select(B.answer_margin(F.col("l"), [0, 1], [2, 3]).alias("m")).head()
    assert row.m == pytest.approx(1.0)
    row = spark.createDataFrame([([0.1, 0.2, 0.3],)], "l array<double>").select(B.answer_margin(F.col("l"), [0, 1], [2]).alias("m")).head()
    assert row.m == pytest.approx(math.log(math.exp(0.1) + math.exp(0.2)) - 0.3)


def test_label_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, "c"), (1, 9, "c")], "id1 bigint, id2 bigint, category string")
    cards = spark.createDataFrame([(1, "aaa"), (2, "a")], "id bigint, card string")
    scorer = R.ModelScorer(lambda: lambda a, b: [len(x) - 0.5 * len(y) for x, y in zip(a, b, strict=True)])
    got = {r.id2: r for r in B.label_pairs(pairs, cards, scorer).collect()}
    assert (got[2].teacher_ab, got[2].teacher_ba, got[2].teacher_score) == (2.5, -0.5, 1.0) and got[9].teacher_ab == 3.0
    one = B.label_pairs(pairs, cards, scorer, symmetric=False).where("id2 = 2").head()
    assert one.teacher_ba is None and one.teacher_score == 2.5


def test_unfit_pairs_and_long_prompts(spark):
    pairs = spark.createDataFrame([(1, 2, "c"), (2, 1, "c"), (1, 1, "c"), (1, 3, "d"), (1, None, "c")], "id1 bigint, id2 bigint, category string")
    cards = spark.createDataFrame([(1, "c"), (2, "c"), (3, "d")], "id bigint, category string")
    assert B.unfit_pairs(pairs, cards) == {"null_ids": 1, "self_pairs": 1, "crossed": 1, "unknown": 1, "misdeclared": 1, "repeated": 1}
    found = B.too_long(spark.createDataFrame([("a b",), ("a " * 2000,), (None,)], "t string"), "t", lambda t: len(t.split()), "short").head()
    assert (found.total, found.too_long, found.longest) == (3, 1, 2000)


def test_chat_has_examples(spark):
    df = B.messages(spark.createDataFrame([("x", "y", "c")], "card1 string, card2 string, category string"), "category")
    turns = df.select(B.chat("s", [("q", "да")]).alias("t"), "user").head()
    assert [t.role for t in turns.t] == ["system", "user", "assistant", "user"] and turns.t[1].content.startswith("q") and turns.t[3].content == turns.user
    assert turns.user.startswith("Категория: c")


def test_order_gap_sources(spark):
    both = spark.createDataFrame([(1.0, 3.0)], "logit_ab double, logit_ba double")
    stored = spark.createDataFrame([(2.0, 2.0)], "logit double, order_gap double")
    a, b = (df.select(S.order_gap_of(df.columns, 0.7, -0.2).alias("g")).head().g for df in (both, stored))
    assert a == pytest.approx(b)
    for bad in (float("nan"), -1.0):
        df = spark.createDataFrame([(2.0, bad)], "logit double, order_gap double")
        with pytest.raises(Exception, match="order gap"):
            df.select(S.order_gap_of(df.columns, 1.0, 0.0)).collect()
    with pytest.raises(ValueError):
        S.order_gap_of(["logit"], 1.0, 0.0)
    assert both.select(S.order_gap_of(["logit"], 1.0, 0.0, True).alias("g")).head().g is None


def test_small_columns(spark):
    df = spark.createDataFrame([("1.5", "c | n | a=1"), ("x", None)], "a string, t string")
    assert [r.n for r in df.select(S.number(F.col("a")).alias("n")).collect()] == [1.5, None]
    assert [r.c for r in df.select(T.text_category(F.col("t")).alias("c")).collect()] == ["c", None]


def test_faults_of_scorers_and_pairs(spark):
    rows = [(0.4, 0.6, 0.5, 0.2, "c"), (0.4, 0.6, 0.7, 0.2, "c"), (0.4, 0.6, 0.5, None, None), (float("nan"), 0.6, 0.5, 0.2, "c")]
    df = spark.createDataFrame(rows, "x_ab double, x_ba double, x double, x_gap double, category string")
    found = C.scorer_faults(df, ["x"], "category").head()
    assert (found.no_group, found.x_range, found.x_mean, found.x_order, found.total) == (1, 0, 2, 2, 4)
    cards = spark.createDataFrame([(1, "p"), (2, "q")], "id bigint, fp string")
    pairs = spark.createDataFrame([(1, 2, "p", "q"), (1, 2, "p", "z"), (1, 3, "p", "q")], "id1 bigint, id2 bigint, item_fp1 string, item_fp2 string")
    found = P.fingerprint_faults(pairs, cards).head()
    assert (found.missing, found.mismatched, found.total) == (1, 1, 3)
    assert C.first_present(["b", "a"], ["a", "c"]) == "a" and C.first_present(["z"], ["a"]) is None
