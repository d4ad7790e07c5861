"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import fusion, groups, leakage, mixing, notation, overlap, products, quota, residue, splits, sql
from pairloom.operators.sampling import portable_int
from pairloom.sources.tables import scan


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation.notation_pairs(scan(spark, sf_dir, "items"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation.collapsed(scan(spark, sf_dir, "items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.torn_comps(scan(spark, sf_dir, "folds_v1"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(scan(spark, sf_dir, "folds_v1"), scan(spark, sf_dir, "split_targets"))[0]


def _two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, given splits in two batches: the second finds components of the first."""
    rows = scan(spark, sf_dir, "folds_v1")
    second = portable_int(F.concat_ws("|", F.lit("batch"), "id1", "id2")) % 2 == 1
    return splits.assign_batches([rows.where(~second), rows.where(second)], scan(spark, sf_dir, "split_targets"))[0]


def p2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and splits of every component after two batches: one split, or none if two met."""
    rows = _two_batches(spark, sf_dir).where("coalesce(comp, id1, id2) is not null")
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("split") > 1).alias("torn"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.match_groups(scan(spark, sf_dir, "matches_llm"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_pairs(scan(spark, sf_dir, "items"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_groups(scan(spark, sf_dir, "items"))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fusion.pair_scores(scan(spark, sf_dir, "mine_candidates"), scan(spark, sf_dir, "matches_llm"))
    return fusion.fuse(scores, ["id1", "id2"], ["ab", "ba", "votes"]).select("id1", "id2", F.round("fused", 12).alias("fused"), "position")


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.leaked_cards(*[scan(spark, sf_dir, t) for t in ("hardval_v1", "hardval_v1_items", "transitive_pairs", "items")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaked(spark, sf_dir).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_leaked(spark, sf_dir), scan(spark, sf_dir, "hardval_v1_items"), scan(spark, sf_dir, "items", "id", "seller_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.shortfalls(scan(spark, sf_dir, "matches_llm"), scan(spark, sf_dir, "items", "id", "category"), scan(spark, sf_dir, "sample_targets"))


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.quota_sample(scan(spark, sf_dir, "matches_llm"), scan(spark, sf_dir, "items", "id", "category"), scan(spark, sf_dir, "sample_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "eval_passages")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = scan(spark, sf_dir, "eval_passages")
    return leakage.leak_report(leakage.leaks(scan(spark, sf_dir, "documents"), passages, paraphrases=True), passages)


def p8_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the verbatim leaks the latent search proposed by itself."""
    found = leakage.leaks(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "eval_passages")).where("verbatim")
    return found.agg(F.count(F.lit(1)).alias("leaks"), F.count_if("latent").alias("by_latent_search"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "items", "id", "category"), scan(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).plan.where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).drawn


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p9_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached tokens of every source, language and topic."""
    return _mix(spark, sf_dir).marginals()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_scores(scan(spark, sf_dir, "documents")).where("found").select("doc_id")


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.validation_report(scan(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.TEXTS)
