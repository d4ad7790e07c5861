"""The registered queries of the engine's own operators, over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import scores as S
from pairloom.functions import text as T
from pairloom.operators import audit as A
from pairloom.operators import consensus as C
from pairloom.operators import graph as G
from pairloom.operators import labelling as B
from pairloom.operators import metrics as M
from pairloom.operators import pairs as P
from pairloom.operators import pool as L
from pairloom.operators import quotas as Q
from pairloom.operators import scoring as R
from pairloom.operators.ranking import exact_quantiles, ordinal
from pairloom.operators.sampling import hash_sample, portable_int, random_key, smallest_per_group
from pairloom.sources.tables import scan
from pairloom.workspace import cut

#: The cap on a card's attributes in training texts, and in inference texts.
TRAIN_CAP, INFER_CAP = 350, 500
ANNOTATORS = [C.Annotator("a", 0.74, 0.1), C.Annotator("b", 0.69, 0.1)]
RULES = C.ConsensusRules()

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


# ---- views over the tables


def delivered(s: SparkSession, d: str, *columns: str, ids: DataFrame | None = None) -> DataFrame:
    """All deliveries of the cards, of ``ids`` only if given: what a query doesn't need never reaches an aggregate."""
    rows = scan(s, d, "items", "id", *columns, "loaded_at")
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def cards(s: SparkSession, d: str, *columns: str, ids: DataFrame | None = None) -> DataFrame:
    """One row per card, with the columns asked for."""
    return P.first_cards(delivered(s, d, *columns, ids=ids))


def weak(s: SparkSession, d: str) -> DataFrame:
    return P.weak_pairs(scan(s, d, "matches_llm", "id1", "id2", "target"))


def human(s: SparkSession, d: str) -> DataFrame:
    """Distinct human pairs with the larger label and the smallest fold of their rows."""
    rows = scan(s, d, "folds_v1").where("id1 <> id2")
    return rows.groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.max("target").alias("target"), F.min("category").alias("category"), F.min("fold").alias("fold"))


def fingerprints(s: SparkSession, d: str) -> DataFrame:
    """(id, fp): hashed row by row, so that digests and not texts are aggregated."""
    fp = T.fingerprint(F.col("name"), F.col("attributes"), F.col("category")).alias("fp")
    return P.first_cards(delivered(s, d, "name", "attributes", "category").select("id", fp, "loaded_at"))


def exclusions(s: SparkSession, d: str) -> DataFrame:
    """(id, fp): cards of the holdout and their fingerprints."""
    rows = scan(s, d, "hardval_v1_items").join(P.endpoints(scan(s, d, "hardval_v1", "id1", "id2")), "id", "left_semi")
    return rows.select("id", T.fingerprint(F.col("name"), F.col("attributes"), F.col("category")).alias("fp")).distinct()


def holdout_pairs(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "hardval_v1", "id1", "id2")


def texts(s: SparkSession, d: str, cap: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, text): written row by row, so that capped texts and not whole attributes are aggregated."""
    rows = T.with_entries(delivered(s, d, "name", "category", "attributes", ids=ids))
    return P.first_cards(rows.select("id", T.card_text(F.col("name"), F.col("category"), F.col("entries"), cap).alias("text"), "loaded_at"))


def lexical(s: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """``pairs`` with text1, text2 and their word overlap; missing cards read as empty."""
    with_text = P.lookup(pairs, texts(s, d, INFER_CAP, P.endpoints(pairs)), "text", "empty")
    return R.LexicalScorer().score(with_text, "score")


def category_of(s: SparkSession, d: str) -> DataFrame:
    return cards(s, d, "category")


def salted(salt: str) -> F.Column:
    """Portable integer of a pair and a salt."""
    return portable_int(F.concat_ws("|", F.lit(salt), "id1", "id2"))


def annotator_scores(s: SparkSession, d: str) -> DataFrame:
    """Two annotators' logits in two orders for every weak pair, drawn around its votes by hash."""
    unit = lambda salt: (salted(salt) % 2001 - 1000) / F.lit(1000.0)
    rows = weak(s, d)
    for t in ("a", "b"):
        base = 0.8 * (F.col("votes") - 4.5) + 1.5 * unit(t)
        rows = rows.withColumn(f"{t}_ab", base + 0.4 * unit(f"{t}ab")).withColumn(f"{t}_ba", base + 0.4 * unit(f"{t}ba"))
        rows = rows.withColumn(f"{t}_logit", (F.col(f"{t}_ab") + F.col(f"{t}_ba")) / 2)
    return rows


def scorer_columns(rows: DataFrame) -> DataFrame:
    """Two scorers x and y in both orders, drawn by hash around a common value; in one row in ten x changes with the order."""
    base, part = salted("ce") % 901, lambda salt: salted(salt) % 100
    rows = rows.withColumn("x_ab", (base + part("cx")) / F.lit(1000.0)).withColumn("y_ab", (base + part("cy")) / F.lit(1000.0)).withColumn("y_ba", (base + part("cyr")) / F.lit(1000.0))
    rows = rows.withColumn("x_ba", F.when(salted("cu") % 10 == 0, 1 - F.col("x_ab")).otherwise((base + part("cxr")) / F.lit(1000.0)))
    for c in ("x", "y"):
        rows = rows.withColumn(c, F.round((F.col(f"{c}_ab") + F.col(f"{c}_ba")) / 2, 6)).withColumn(f"{c}_gap", F.abs(F.col(f"{c}_ab") - F.col(f"{c}_ba")))
    return rows


def judged(s: SparkSession, d: str, vetoes: bool = True) -> DataFrame:
    """Weak pairs with the consensus of the two annotators; a hash flag stands for a rule's conflict.

    With ``vetoes`` two scorers, ranked within the category of the first card, may veto; only queries
    that show nothing of acceptance do without.
    """
    rows = annotator_scores(s, d)
    if vetoes:
        rows = scorer_columns(rows.join(category_of(s, d).select(F.col("id").alias("id1"), "category"), "id1", "left"))
    rows = cut(rows, "scores")  # as a table of annotators' scores would be
    if vetoes:
        rows = C.scorer_ranks(rows, ["x", "y"], "category")
    for t in ("a", "b"):
        rows = rows.withColumn(f"p_{t}", S.platt(F.col(f"{t}_logit"), 1.0, 0.0)).withColumn(f"gap_{t}", S.order_gap(F.col(f"{t}_ab"), F.col(f"{t}_ba"), 1.0, 0.0))
    rows = rows.withColumn("identifier_conflict", (salted("rule") % 20 == 0).cast("double"))
    return C.decide(rows, ANNOTATORS, RULES, C.rule_conflict(["identifier_conflict", "quantity_conflict", "model_conflict"], rows.columns), ["x", "y"] if vetoes else None)


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# ---- scans


@query
def q_scan(s, d):
    return scan(s, d, "transitive_pairs")


@query
def q_item_subset(s, d):
    ids = P.endpoints(scan(s, d, "mine_candidates", "id1", "id2"))
    return scan(s, d, "items", "id", "name", "category").join(ids, "id", "left_semi")


@query
def q_needed_items(s, d):
    return cards(s, d, "category", ids=P.endpoints(holdout_pairs(s, d)))


# ---- projections


@query
def q_card_text(s, d):
    return texts(s, d, TRAIN_CAP)


def prompt_cards(rows: DataFrame) -> DataFrame:
    return T.with_entries(rows, normalised=False).select("id", T.prompt_card(F.col("name"), F.col("entries")).alias("card"))


@query
def q_prompt_card(s, d):
    return prompt_cards(cards(s, d, "name", "attributes"))


@query
def q_messages(s, d):
    pairs = scan(s, d, "hardval_v1").distinct()
    shown = prompt_cards(cards(s, d, "name", "attributes", ids=P.endpoints(pairs)))
    return B.messages(P.attach(pairs, shown, "card")).select("id1", "id2", "label", "user")


@query
def q_fingerprint(s, d):
    return fingerprints(s, d)


@query
def q_canonical_pairs(s, d):
    return P.canonical(scan(s, d, "transitive_pairs").where("id1 is not null and id2 is not null")).select("lo", "hi", "target")


@query
def q_pair_keys(s, d):
    return P.pair_keys(scan(s, d, "matches_llm", "id1", "id2"))


@query
def q_sigmoid(s, d):
    return annotator_scores(s, d).select("id1", "id2", F.round(S.stable_sigmoid(F.col("a_logit")), 6).alias("p"))


@query
def q_platt(s, d):
    return annotator_scores(s, d).select("id1", "id2", F.round(S.platt(F.col("b_logit"), 0.7, -0.2), 6).alias("p"))


@query
def q_order_gap(s, d):
    return annotator_scores(s, d).select("id1", "id2", F.round(S.order_gap(F.col("a_ab"), F.col("a_ba"), 0.7, -0.2), 6).alias("gap"))


@query
def q_votes(s, d):
    return P.sound(scan(s, d, "matches_llm", "id1", "id2", "target")).select("id1", "id2", S.votes(F.col("target")).alias("votes"))


@query
def q_bands(s, d):
    j = name_similarity(s, d, weak(s, d))
    return j.select("id1", "id2", S.band(F.col("votes")).alias("band"), S.similarity_band(F.col("jaccard")).alias("jband"))


@query
def q_confidence_weight(s, d):
    return weak(s, d).select("id1", "id2", F.round(S.confidence(F.col("target")), 6).alias("confidence"), F.round(S.base_weight(F.col("target")), 6).alias("weight"))


@query
def q_ivar_weight(s, d):
    return L.variance_weights(weak(s, d), "weight").select("id1", "id2", F.round("weight", 6).alias("weight"))


def name_similarity(s, d, pairs: DataFrame) -> DataFrame:
    tokens = cards(s, d, "name", ids=P.endpoints(pairs)).select("id", T.name_tokens(F.col("name")).alias("tokens"))
    none = F.array().cast("array<string>")
    both = P.attach(pairs, tokens, "tokens")
    return both.withColumn("jaccard", T.set_jaccard(F.coalesce("tokens1", none), F.coalesce("tokens2", none), -1.0)).drop("tokens1", "tokens2")


@query
def q_name_jaccard(s, d):
    return name_similarity(s, d, weak(s, d)).select("id1", "id2", F.round("jaccard", 6).alias("jaccard"))


@query
def q_lexical_score(s, d):
    return lexical(s, d, weak(s, d)).select("id1", "id2", F.round("score", 6).alias("score"))


@query
def q_category_codes(s, d):
    names = scan(s, d, "items", "category").where("category is not null").distinct()
    return names.select("category", (F.dense_rank().over(Window.orderBy("category")) - 1).alias("code"))  # one row per category


@query
def q_shard(s, d):
    return weak(s, d).select("id1", "id2", (salted("shard") % 4).alias("shard")).where("shard = 1")


@query
def q_halves(s, d):
    rows = scan(s, d, "hardval_v1").distinct()
    return rows.select("id1", "id2", "label", (portable_int(F.concat_ws("|", F.lit("half"), "id1")) % 2).alias("half"))


@query
def q_swap_augment(s, d):
    turn = salted("swap") % 2 == 1
    return weak(s, d).select(F.when(turn, F.col("id2")).otherwise(F.col("id1")).alias("first"), F.when(turn, F.col("id1")).otherwise(F.col("id2")).alias("second"), "votes")


@query
def q_swap_average(s, d):
    both = scan(s, d, "mine_candidates")
    ok = S.finite(F.col("teacher_ab")).isNotNull() & S.finite(F.col("teacher_ba")).isNotNull()
    return both.where(ok).select("id1", "id2", F.round((F.col("teacher_ab") + F.col("teacher_ba")) / 2, 6).alias("mean_score"))


@query
def q_nan_clean(s, d):
    return scan(s, d, "mine_candidates").select("id1", "id2", F.round(S.clean(F.col("teacher_ab")), 6).alias("score"))


@query
def q_pair_length(s, d):
    pairs = scan(s, d, "hardval_v1", "id1", "id2").distinct()
    full = P.lookup(pairs, texts(s, d, INFER_CAP, P.endpoints(pairs)), "text", "drop")
    return full.select("id1", "id2", (F.length("text1") + F.length("text2")).alias("length"))


# ---- filters


@query
def q_exclude_pairs(s, d):
    return P.exclude_pairs(weak(s, d), holdout_pairs(s, d)).select("id1", "id2", "votes")


@query
def q_exclude_entities(s, d):
    return P.exclude_entities(weak(s, d), P.endpoints(holdout_pairs(s, d))).select("id1", "id2", "votes")


@query
def q_exclude_fingerprints(s, d):
    held = fingerprints(s, d).join(exclusions(s, d).select("fp").distinct(), "fp", "left_semi").select("id")
    return P.exclude_entities(weak(s, d), cut(held, "held")).select("id1", "id2", "votes")


@query
def q_purge_audit(s, d):
    out = exclusions(s, d)
    return L.purge_flags(weak(s, d), holdout_pairs(s, d), out.select("id").distinct(), out.select("fp").distinct(), fingerprints(s, d)).agg(
        F.count_if("by_pair").alias("by_pair"), F.count_if("by_id").alias("by_id"), F.count_if("by_fp").alias("by_fp"), F.count_if(F.expr("by_pair or by_id or by_fp")).alias("any_reason"), F.count(F.lit(1)).alias("total")
    )


@query
def q_val_purge(s, d):
    first = P.endpoints(human(s, d).where("fold = 0"))
    fps = fingerprints(s, d)
    held = fps.join(fps.join(first, "id", "left_semi").select("fp").distinct(), "fp", "left_semi").select("id")
    return P.exclude_entities(weak(s, d), cut(held, "held")).select("id1", "id2", "votes")


@query
def q_confident(s, d):
    return weak(s, d).where("votes <= 1 or votes >= 7").select("id1", "id2", (F.col("votes") >= 7).cast("int").alias("label"))


@query
def q_min_confidence(s, d):
    return weak(s, d).where(S.confidence(F.col("target")) >= 0.5).select("id1", "id2", "votes")


@query
def q_sample_complement(s, d):
    rows = weak(s, d).withColumn("key", random_key("pre", F.col("id1"), F.col("id2")))
    taken = cut(hash_sample(rows, "key", 1000), "taken")
    return rows.join(taken.select("id1", "id2"), ["id1", "id2"], "left_anti").select("id1", "id2", "votes")


@query
def q_endpoints_present(s, d):
    return P.with_endpoints(weak(s, d), cards(s, d).select("id")).select("id1", "id2", "votes")


@query
def q_human_val(s, d):
    return scan(s, d, "folds_v1").where("fold = 0").select("id1", "id2", F.col("target").alias("label"), "category")


@query
def q_pair_violations(s, d):
    return P.violations(scan(s, d, "matches_llm", "id1", "id2"))


@query
def q_rule_conflict(s, d):
    rows = weak(s, d).select("id1", "id2", (salted("r1") % 5 / F.lit(4.0)).alias("identifier_conflict"), (salted("r2") % 3 / F.lit(2.0)).alias("model_conflict"))
    return rows.select("id1", "id2", C.rule_conflict(["identifier_conflict", "quantity_conflict", "model_conflict"], rows.columns).alias("conflict"))


# ---- joins


@query
def q_pair_texts(s, d):
    pairs = scan(s, d, "mine_candidates", "id1", "id2").distinct()
    return P.lookup(pairs, texts(s, d, INFER_CAP, P.endpoints(pairs)), "text", "empty").select("id1", "id2", F.md5("text1").alias("m1"), F.md5("text2").alias("m2"))


@query
def q_eval_join(s, d):
    return P.pair_keys(scan(s, d, "mine_candidates")).withColumnsRenamed({"lo": "id1", "hi": "id2"}).join(weak(s, d), ["id1", "id2"]).select("id1", "id2", "votes")


def _scores(s, d, salt: str) -> DataFrame:
    return annotator_scores(s, d).where(salted(salt) % 10 > 0).select(F.col("id1").alias("lo"), F.col("id2").alias("hi"), F.col(f"{salt}_logit").alias("logit"), "votes")


@query
def q_align_teachers(s, d):
    rows = C.align({t: _scores(s, d, t) for t in ("a", "b")}, ["logit"], ["votes"], strict=False)
    return rows.select("lo", "hi", r6("logit_a"), r6("logit_b"), F.col("votes").isNotNull().alias("agree"))


@query
def q_key_diff(s, d):
    return C.key_difference(_scores(s, d, "a"), _scores(s, d, "b"))


@query
def q_override(s, d):
    extra = scan(s, d, "transitive_pairs").where("target is not null and id1 <> id2").groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.max("target").alias("target"))
    return P.override(weak(s, d).select("id1", "id2", F.round("target", 6).alias("target")), extra)


@query
def q_pair_category(s, d):
    return weak(s, d).join(category_of(s, d).select(F.col("id").alias("id1"), "category"), "id1", "left").select("id1", "id2", "category")


@query
def q_category_mismatch(s, d):
    both = P.attach(weak(s, d), category_of(s, d), "category")
    return both.agg(F.count_if(F.col("category1") != F.col("category2")).alias("crossed"), F.count_if(F.expr("category1 is null or category2 is null")).alias("unknown"), F.count(F.lit(1)).alias("total"))


@query
def q_pair_fingerprints(s, d):
    return P.attach(scan(s, d, "hardval_v1", "id1", "id2").distinct(), fingerprints(s, d), "fp")


# ---- aggregations


def _scored(s, d) -> DataFrame:
    """Human-labelled holdout pairs with lexical scores and the first card's category."""
    rows = scan(s, d, "hardval_v1").where("label is not null and category is not null").groupBy("id1", "id2").agg(F.max("label").alias("label"), F.min("category").alias("category"))
    return lexical(s, d, rows).withColumn("score", F.round("score", 6))


@query
def q_ap_by_category(s, d):
    return M.average_precision(_scored(s, d), "category", "score", "label").select("category", "n", "pos", r6("ap"))


@query
def q_macro_ap(s, d):
    return M.macro_average_precision(M.average_precision(_scored(s, d), "category", "score", "label"), "evaluation").select("groups", r6("macro_ap"))


@query
def q_macro_ap_training(s, d):
    return M.macro_average_precision(M.average_precision(_scored(s, d), "category", "score", "label"), "training").select("groups", r6("macro_ap"))


@query
def q_accuracy(s, d):
    pairs = P.pair_keys(scan(s, d, "mine_candidates")).withColumnsRenamed({"lo": "id1", "hi": "id2"})
    rows = pairs.join(annotator_scores(s, d), ["id1", "id2"]).where("votes <= 1 or votes >= 8").select((F.col("votes") >= 8).cast("int").alias("label"), "a_logit")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(((F.col("a_logit") > 0).cast("int") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query
def q_category_label_counts(s, d):
    return scan(s, d, "folds_v1").groupBy("category", "target").agg(F.count(F.lit(1)).alias("n"))


@query
def q_fold_sizes(s, d):
    return scan(s, d, "folds_v1").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query
def q_distinct_counts(s, d):
    return exclusions(s, d).agg(F.count_distinct("id").alias("ids"), F.count_distinct("fp").alias("fps"))


@query
def q_conflicting_ids(s, d):
    rows = scan(s, d, "items", "id", "name", "category", "attributes").unionByName(scan(s, d, "hardval_v1_items", "id", "name", "category", "attributes"))
    planted = rows.where(portable_int(F.concat_ws("|", F.lit("conflict"), "id")) % 50 == 0).withColumn("category", F.lit("planted"))  # the tables themselves have no conflict
    return rows.unionByName(planted).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


@query
def q_pool_summary(s, d):
    return weak(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("target"), 6).alias("mean_target"), F.round(F.stddev_samp("target"), 6).alias("std_target"), F.round(F.avg((F.col("votes") >= 8).cast("double")), 6).alias("positive_share"))


@query
def q_length_percentiles(s, d):
    n = cut(texts(s, d, TRAIN_CAP).select(F.length("text").alias("n")), "lengths")
    p50, p99 = exact_quantiles(n, F.col("n"), [0.5, 0.99])
    return n.agg(F.round(F.lit(p50).cast("double"), 6).alias("p50"), F.round(F.lit(p99).cast("double"), 6).alias("p99"), F.max("n").alias("longest"))


@query
def q_constant_baseline(s, d):
    rows = scan(s, d, "hardval_v1").where("label is not null and category is not null").distinct()
    return rows.groupBy("category").agg(F.avg("label").alias("share")).agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("share"), 6).alias("macro_share"))


# ---- ranks


@query
def q_rank01(s, d):
    rows = annotator_scores(s, d).select("id1", "id2", F.round("a_logit", 6).alias("score"))
    return R.rank01(rows, "score", [F.col("id1"), F.col("id2")], "rank01").select("id1", "id2", F.round("rank01", 9).alias("rank01"))


@query
def q_pct_rank(s, d):
    rows = weak(s, d).join(category_of(s, d).select(F.col("id").alias("id1"), "category"), "id1").where("category is not null")
    return M.percentile_rank(rows, "category", "votes", "rank").select("id1", "id2", F.round("rank", 9).alias("rank"))


@query
def q_rank_blend(s, d):
    rows = annotator_scores(s, d).select("id1", "id2", F.round("a_logit", 6).alias("a"), F.round("b_logit", 6).alias("b"))
    order = [F.col("id1"), F.col("id2")]
    ranked = R.rank01(R.rank01(rows, "a", order, "ra"), "b", order, "rb")
    return R.blend(ranked, {"ra": 0.55, "rb": 0.45}, "predict").select("id1", "id2", F.round("predict", 9).alias("predict"))


@query
def q_dedup_items(s, d):
    return cards(s, d, "name", "category", "seller_id")


@query
def q_duplicates(s, d):
    keys = P.canonical(scan(s, d, "matches_llm", "id1", "id2")).where("lo is not null and hi is not null")
    return keys.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query
def q_content_dups(s, d):
    both = P.attach(weak(s, d), fingerprints(s, d), "fp").where("fp1 is not null and fp2 is not null")
    return C.content_duplicates(both, [F.col("id1"), F.col("id2")]).where("duplicate").select("id1", "id2")


@query
def q_ce_veto(s, d):
    negative, positive = C.rank_vetoes(["x", "y"], RULES)
    flags = judged(s, d).select("id1", "id2", ((F.col("consensus") <= RULES.negative) & negative).alias("negative_veto"), ((F.col("consensus") >= RULES.positive) & positive).alias("positive_veto"))
    return flags.where("negative_veto or positive_veto")


@query
def q_scorer_faults(s, d):
    rows = scorer_columns(weak(s, d).join(category_of(s, d).select(F.col("id").alias("id1"), "category"), "id1", "left"))
    wrong = rows.withColumn("x", F.when(salted("f1") % 40 == 0, F.col("x") + 0.001).otherwise(F.col("x"))).withColumn("y_gap", F.when(salted("f2") % 30 == 0, F.lit(0.5)).otherwise(F.col("y_gap")))
    return C.scorer_faults(wrong, ["x", "y"], "category")


# ---- samples and quotas


@query
def q_topk_global(s, d):
    return judged(s, d).where("accepted").select("id1", "id2", F.round("quality", 6).alias("quality")).orderBy(F.desc("quality"), "id1", "id2").limit(200)


def _with_category(s, d, rows: DataFrame) -> DataFrame:
    return rows.join(category_of(s, d).select(F.col("id").alias("id1"), "category"), "id1").where("category is not null")


@query
def q_topk_cell(s, d):
    rows = _with_category(s, d, judged(s, d).where("accepted").select("id1", "id2", "label", F.round("quality", 6).alias("quality")))
    w = Window.partitionBy("category", "label").orderBy(F.desc("quality"), "id1", "id2")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 5")


@query
def q_sample(s, d):
    rows = weak(s, d).withColumn("key", random_key("sample", F.col("id1"), F.col("id2")))
    return hash_sample(rows, "key", 500).select("id1", "id2", "votes")


@query
def q_cap_posfrac(s, d):
    rows = weak(s, d).withColumn("key", random_key("cap", F.col("id1"), F.col("id2"))).withColumn("positive", F.col("target") >= 0.5)
    return L.capped(rows, "positive", "key", 800, 0.35).select("id1", "id2", "votes")


@query
def q_holdout(s, d):
    rows = _with_category(s, d, weak(s, d).where("votes <= 1 or votes >= 7")).withColumn("label", (F.col("votes") >= 7).cast("int"))
    return L.holdout(rows.withColumn("key", random_key("holdout", F.col("id1"), F.col("id2"))), 1000).select("id1", "id2", "label", "category")


def _cells(s, d) -> DataFrame:
    j = _with_category(s, d, name_similarity(s, d, weak(s, d)))
    return j.withColumn("band", S.band(F.col("votes"))).withColumn("jband", S.similarity_band(F.col("jaccard")))


@query
def q_stratum_stats(s, d):
    counts = _cells(s, d).groupBy("category", "band", "jband").agg(F.count(F.lit(1)).alias("available"))
    return Q.stratum_quotas(counts, "category", 40)


@query
def q_stratified_pool(s, d):
    rows = cut(_cells(s, d), "cells")
    quotas = Q.stratum_quotas(rows.groupBy("category", "band", "jband").agg(F.count(F.lit(1)).alias("available")), "category", 40)
    keyed = rows.join(quotas.drop("available"), ["category", "band", "jband"]).withColumn("key", random_key("pool", F.col("id1"), F.col("id2")))
    picked = smallest_per_group(keyed, ["category", "band", "jband"], "key", "quota")
    return L.variance_weights(picked, "sample_weight").select("id1", "id2", F.round("sample_weight", 6).alias("sample_weight"), "votes", "jband")


@query
def q_apportion(s, d):
    counts = _with_category(s, d, weak(s, d)).groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return Q.apportion(counts, "category", "n", 1001).select("category", "quota")


@query
def q_cell_quota(s, d):
    counts = _with_category(s, d, weak(s, d)).groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return Q.cell_quotas(Q.apportion(counts, "category", "n", 1001).select("category", "quota"), "category")


def _balanced(s, d, by_label: bool, requested: int) -> DataFrame:
    """The best accepted pairs, balanced; by label over the categories that have five pairs of either label."""
    rows = cut(judged(s, d).where("category is not null").select("id1", "id2", "category", "label", "accepted", F.round("quality", 6).alias("quality")), "judged")
    pool = rows.where("accepted")
    if by_label:
        both = pool.groupBy("category").agg(F.count_if(F.expr("label = 1")).alias("p"), F.count_if(F.expr("label = 0")).alias("n")).where("least(p, n) >= 5")
        pool = pool.join(both, "category", "left_semi")
    shares = None if by_label else {r.category: float(r["count"]) for r in rows.groupBy("category").count().collect()}  # one row per category
    chosen, _ = Q.select_balanced(pool, "category", "label", "quality", ["id1", "id2"], requested, by_label, shares, allow_missing=True, min_output=0)
    return chosen.select("id1", "id2", "category", "label")


@query
def q_select_balanced(s, d):
    return _balanced(s, d, False, 400)


@query
def q_select_label_balanced(s, d):
    return _balanced(s, d, True, 150)


@query
def q_batches(s, d):
    keyed = _with_category(s, d, weak(s, d)).withColumn("key", random_key("batch", F.col("id1"), F.col("id2")))
    return ordinal_batches(keyed, 16)


def ordinal_batches(keyed: DataFrame, size: int) -> DataFrame:
    """(category, batch, n): batches of one category each, in random order."""
    placed = ordinal(keyed, [F.col("category"), F.col("key")], "at")
    first = placed.groupBy("category").agg(F.min("at").alias("first"))
    numbered = placed.join(first, "category").withColumn("batch", F.floor((F.col("at") - F.col("first")) / size))
    return numbered.groupBy("category", "batch").agg(F.count(F.lit(1)).alias("n"))


@query
def q_reserve(s, d):
    rows = judged(s, d).where("accepted").select("id1", "id2", F.round("quality", 6).alias("quality"))
    top = cut(rows.orderBy(F.desc("quality"), "id1", "id2").limit(200), "top")
    return rows.join(top.select("id1", "id2"), ["id1", "id2"], "left_anti").select("id1", "id2")


# ---- sets


@query
def q_training_pool(s, d):
    return L.training_pool(s, d).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("mass"), F.round(F.avg("target"), 6).alias("mean_target"))


@query
def q_stream_weights(s, d):
    return C.normalise_streams(L.training_pool(s, d), "stream", "weight", {"base": 0.5, "extra": 0.2, "human": 0.3}).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("mass"))


@query
def q_endpoints(s, d):
    return P.endpoints(scan(s, d, "matches_llm", "id1", "id2"), scan(s, d, "transitive_pairs", "id1", "id2"))


@query
def q_leak_check(s, d):
    held = P.endpoints(holdout_pairs(s, d))
    shared = lambda pairs, name: P.endpoints(pairs).join(held, "id", "left_semi").agg(F.count("id").alias(name))
    return shared(weak(s, d), "before").join(shared(P.exclude_pairs(weak(s, d), holdout_pairs(s, d)), "without_pairs")).join(shared(P.exclude_entities(weak(s, d), held), "without_ids"))  # one row each


@query
def q_banned(s, d):
    out = exclusions(s, d)
    return G.banned_and_aliases(out.select("id"), fingerprints(s, d), out.select("fp"))


# ---- graphs


def _positive(s, d) -> DataFrame:
    return weak(s, d).where("votes >= 8").select("id1", "id2")


@query
def q_components(s, d):
    return G.pair_components(_positive(s, d)).select(F.col("node").alias("id"), F.col("label").alias("comp"))


def _fold_components(s, d) -> DataFrame:
    pairs = human(s, d)
    fps = fingerprints(s, d).join(P.endpoints(pairs), "id", "left_semi")
    edges = pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).unionByName(G.alias_edges(fps))
    return G.propagate(edges).select(F.col("node").alias("id"), F.col("label").alias("comp"))


@query
def q_fold_components(s, d):
    return _fold_components(s, d)


@query
def q_folds(s, d):
    comp = _fold_components(s, d).withColumnRenamed("id", "id1")
    return human(s, d).join(comp, "id1").select("id1", "id2", "comp", G.fold_of(F.col("comp")).alias("fold"))


def _closure(s, d) -> tuple[DataFrame, ...]:
    rows = cut(weak(s, d).select("id1", "id2", "votes"), "weak")
    banned = cut(P.endpoints(holdout_pairs(s, d)), "banned")
    pos, neg = rows.where("votes >= 8"), rows.where("votes <= 1")
    clusters = cut(G.kept_clusters(G.pair_components(pos), banned), "clusters")
    return clusters, pos, neg, banned


@query
def q_clusters(s, d):
    return _closure(s, d)[0]


@query
def q_transitive_pos(s, d):
    clusters, pos, _, _ = _closure(s, d)
    return G.transitive_positives(clusters, pos)


@query
def q_transitive_neg(s, d):
    return G.transitive_negatives(*_closure(s, d))


@query
def q_transitive_pairs(s, d):
    return G.transitive_pairs(*_closure(s, d))


@query
def q_transitive_limited(s, d):
    return G.transitive_pairs(*_closure(s, d), max_positives=100, max_negatives=300)


@query
def q_alias_ban(s, d):
    return fingerprints(s, d).join(exclusions(s, d).select("fp").distinct(), "fp", "left_semi").select("id")


# ---- consensus


@query
def q_consensus(s, d):
    return judged(s, d, vetoes=False).select("id1", "id2", r6("consensus"), r6("spread"), r6("max_gap"), "confident")


@query
def q_consensus_stats(s, d):
    return judged(s, d, vetoes=False).select("id1", "id2", r6("weighted_std"), "conflicting")


@query
def q_consensus_accept(s, d):
    return judged(s, d).where("accepted").select("id1", "id2", "label")


@query
def q_consensus_reasons(s, d):
    return judged(s, d).select("id1", "id2", F.array_join("reasons", ";").alias("reason"))


@query
def q_reason_counts(s, d):
    return judged(s, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def q_consensus_quality(s, d):
    return judged(s, d, vetoes=False).select("id1", "id2", r6("quality"), r6("sample_weight"))


@query
def q_consensus_adjudication(s, d):
    rest = judged(s, d).where("not accepted")
    return rest.select("id1", "id2", F.concat(F.array_join("reasons", ";")).alias("adjudication_reason"))


@query
def q_calibration_gap(s, d):
    """Stored probabilities of which one in forty was planted a little off."""
    right = S.platt(F.col("a_logit"), 0.7, -0.2)
    rows = annotator_scores(s, d).withColumn("stored", F.round(right + F.when(salted("off") % 40 == 0, 0.001).otherwise(0.0), 6))
    return rows.agg(F.count_if(F.abs(F.col("stored") - right) > 2e-5).alias("beyond"), F.count(F.lit(1)).alias("total"))


@query
def q_leakage(s, d):
    out = exclusions(s, d)
    return L.leakage_reasons(weak(s, d), holdout_pairs(s, d), out.select("id").distinct(), out.select("fp").distinct(), fingerprints(s, d))


@query
def q_contract_violations(s, d):
    """Faults of a stored table of accepted pairs in which some values were planted wrong and some pairs repeat."""
    kept = ["id1", "id2", "category", "label", *[f"{c}_{t}" for c in ("p", "gap") for t in ("a", "b")], "spread", "max_gap", "confident", "quality", "sample_weight"]
    stored = judged(s, d).where("accepted").select(F.col("consensus").alias("target"), *kept)
    off = lambda c, salt, n, by: F.when(salted(salt) % n == 0, F.col(c) + by).otherwise(F.col(c)).alias(c)
    planted = {"target": ("t", 30, 0.001), "spread": ("s", 40, 0.001), "max_gap": ("g", 50, 0.001), "confident": ("n", 60, 1), "quality": ("q", 35, 0.001), "sample_weight": ("w", 45, 0.1), "label": ("l", 55, 2)}
    wrong = stored.select(*[off(c, *planted[c]) if c in planted else F.col(c) for c in stored.columns])
    table = cut(wrong.unionByName(wrong.where(salted("again") % 25 == 0)), "stored")
    out = exclusions(s, d)
    return A.contract_faults(table, ANNOTATORS, RULES, holdout_pairs(s, d), out.select("id").distinct())


@query
def q_exclusion_evidence(s, d):
    return A.exclusion_evidence(holdout_pairs(s, d), exclusions(s, d))


@query
def q_fingerprint_faults(s, d):
    both = P.attach(weak(s, d), fingerprints(s, d), "fp").withColumnsRenamed({"fp1": "item_fp1", "fp2": "item_fp2"})
    planted = both.withColumn("item_fp1", F.when(salted("fp") % 20 == 0, F.lit("0")).otherwise(F.col("item_fp1")))
    return P.fingerprint_faults(planted, fingerprints(s, d))


@query
def q_category_faults(s, d):
    return P.category_faults(scan(s, d, "mine_candidates", "id1", "id2", "category"), category_of(s, d))


# ---- small columns


@query
def q_text_category(s, d):
    return texts(s, d, TRAIN_CAP).select("id", T.text_category(F.col("text")).alias("category"))


@query
def q_numbers(s, d):
    found = F.regexp_extract("name", r"[0-9][0-9.,x]*", 0)
    return cards(s, d, "name").select("id", F.round(S.number(found), 6).alias("number"))


@query
def q_stored_gap(s, d):
    rows = annotator_scores(s, d).select("id1", "id2", F.col("a_logit").alias("logit"), F.abs(F.col("a_ab") - F.col("a_ba")).alias("order_gap"))
    return rows.select("id1", "id2", F.round(S.order_gap_of(rows.columns, 0.7, -0.2), 6).alias("gap"))


@query
def q_human_sample(s, d):
    rows = human(s, d).where("target is not null and (fold is null or fold <> 0)").withColumn("key", random_key("human", F.col("id1"), F.col("id2")))
    return hash_sample(rows, "key", 200).select("id1", "id2", "target")


@query
def q_macro_ap_labelling(s, d):
    return M.macro_average_precision(M.average_precision(_scored(s, d), "category", "score", "label"), "labelling", min_rows=100).select("groups", r6("macro_ap"))


@query
def q_answer_margin(s, d):
    """log p(yes) - log p(no) where a row's scores stand for the logits of two tokens of either answer."""
    rows = scan(s, d, "mine_candidates")
    ok = F.array(*[S.finite(F.col(c)) for c in ("teacher_ab", "teacher_ba", "teacher_score", "teacher_prob")])
    logits = F.transform(ok, lambda x: S.clip(x, -50.0, 50.0))
    sound = rows.where(~F.exists(ok, lambda x: x.isNull()))
    return sound.select("id1", "id2", F.round(B.answer_margin(logits, [0, 1], [2, 3]), 6).alias("margin"))


@query
def q_prompt(s, d):
    """The whole question with its category."""
    pairs = scan(s, d, "hardval_v1").where("category is not null").distinct()
    shown = prompt_cards(cards(s, d, "name", "attributes", ids=P.endpoints(pairs)))
    return B.messages(P.attach(pairs, shown, "card"), "category").select("id1", "id2", "label", "category", F.md5("user").alias("prompt"))


# ---- models


@query
def q_pair_score(s, d):
    pairs = scan(s, d, "hardval_v1", "id1", "id2").distinct()
    with_text = P.lookup(pairs, texts(s, d, INFER_CAP, P.endpoints(pairs)), "text", "empty")

    def load():
        return lambda a, b: [len(set(x.split()) & set(y.split())) / max(1, len(set(x.split()) | set(y.split()))) for x, y in zip(a, b, strict=True)]

    return R.swap_averaged(with_text, R.ModelScorer(load), "score", ["id1", "id2"]).select("id1", "id2", F.round("score", 6).alias("score"))


@query
def q_rank_loss(s, d):
    return L.rank_loss(_scored(s, d), "category", "score", "label")


@query
def q_train_lr(s, d):
    return L.soft_label_model(name_similarity(s, d, weak(s, d)).select("id1", "id2", "target", F.col("jaccard").alias("x")), ["x"])
