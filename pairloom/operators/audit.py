"""Evidence around a consensus: gates of annotators, exclusion evidence, audits, and the check of a stored table."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.consensus import Annotator, ConsensusRules, consensus_columns, quality_column
from pairloom.operators.pairs import endpoints, pair_keys
from pairloom.sources.files import sha256_files

_SHA256 = re.compile(r"[0-9a-f]{64}")


@dataclass(frozen=True)
class GateRules:
    """What a gate report must hold: flags that are true, bounds by dotted path, and texts by dotted path.

    The defaults are those that the consensus itself relies on; production floors are the caller's.
    """

    true: tuple[str, ...] = ("passed", "bidirectional", "no_tokenizer_truncation", "calibration_evaluation_disjoint")
    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: {"teacher_macro_ap": (0.58, 1.0), "calibration.slope": (1e-12, math.inf), "calibration.rows": (1, math.inf), "calibration.reference_positive_prior": (1e-12, 1 - 1e-12)})
    texts: dict[str, str] = field(default_factory=lambda: {"calibration.fit_role": "calibration", "calibration.fit_stratum": "representative"})
    thresholds: tuple[str, ...] = ("heldout_decision_audit", "hard_negative_audit")


def at_path(report: dict, path: str):
    """The value under a dotted path, or None."""
    for part in path.split("."):
        report = report.get(part) if isinstance(report, dict) else None
    return report


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return math.nan


def gate_faults(report: dict, gate: GateRules, rules: ConsensusRules, tolerance: float = 1e-6) -> list[str]:
    """What is wrong with a gate report, as readable lines; empty for a sound one.

    Besides ``gate``: a model name, a prompt digest, a constant score's precision below the
    model's, decision thresholds equal to those of ``rules``, and no negative delta of a component half.
    """
    wrong = [f"{k} is not true" for k in gate.true if report.get(k) is not True]
    wrong += [f"{k} = {at_path(report, k)!r} is outside {low:g}..{high:g}" for k, (low, high) in gate.ranges.items() if not low <= _number(at_path(report, k)) <= high]
    wrong += [f"{k} = {at_path(report, k)!r}, not {v!r}" for k, v in gate.texts.items() if at_path(report, k) != v]
    if not str(report.get("model") or "").strip():
        wrong.append("no model is named")
    if not _SHA256.fullmatch(str(report.get("prompt_contract_sha256", ""))):
        wrong.append("no digest of the prompt")
    if not 0 < _number(report.get("teacher_macro_ap_constant")) < _number(report.get("teacher_macro_ap")):
        wrong.append("no constant score's precision below the model's")
    for part in gate.thresholds:
        for key, value in (("negative_threshold", rules.negative), ("positive_threshold", rules.positive)):
            if not abs(_number(at_path(report, f"{part}.{key}")) - value) <= tolerance:
                wrong.append(f"{part}.{key} was not validated at {value}")
    wrong += [f"component half {k} gets worse" for k, v in (report.get("component_halves") or {}).items() if not _number(v.get("delta")) >= 0]
    return wrong


def metadata_faults(meta: dict, report: dict, tolerance: float = 1e-6) -> list[str]:
    """What of a score table's metadata contradicts the gate report of its model."""
    same = ["model", "prompt_contract_sha256", "yes_token_id", "no_token_id"]
    wrong = [f"{k} = {meta.get(k)!r}, the gate has {report.get(k)!r}" for k in same if meta.get(k) != report.get(k)]
    if meta.get("tokenizer_truncation") is not False:
        wrong.append("texts may have been cut")
    if meta.get("bidirectional") is not True:
        wrong.append("only one order was scored")
    for k in ("slope", "intercept"):
        if not abs(_number(at_path(meta, f"probability_calibration.{k}")) - _number(at_path(report, f"calibration.{k}"))) <= tolerance:
            wrong.append(f"calibration {k} is another one")
    return wrong


def exclusion_evidence(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: distinct unordered pairs, ids and fingerprints to be excluded, and rows with a null id or an empty fingerprint."""
    keys = pair_keys(pairs.where("id1 is not null and id2 is not null")).agg(F.count(F.lit(1)).alias("pair_keys"))
    cards = items.agg(F.count_distinct("id").alias("item_ids"), F.count_distinct(F.when(F.trim("fp") != "", F.col("fp"))).alias("item_fingerprints"), F.count_if(F.expr("id is null")).alias("null_ids"), F.count_if(F.expr("fp is null or trim(fp) = ''")).alias("empty_fps"))
    return keys.join(cards)  # one row each


def exclusion_files(spark: SparkSession, pair_paths: list[str], item_paths: list[str]) -> dict:
    """The evidence with the SHA-256 of every file it came from; empty evidence raises."""
    row = exclusion_evidence(spark.read.parquet(*pair_paths), spark.read.parquet(*item_paths)).head().asDict()
    if not row["pair_keys"] or not row["item_ids"] or not row["item_fingerprints"] or row["null_ids"] or row["empty_fps"]:
        raise ValueError(f"exclusions are incomplete: {row}")
    files = lambda paths: sorted(r.sha256 for p in paths for r in sha256_files(spark, f"{p}/*.parquet" if not p.endswith(".parquet") else p).collect())
    return row | {"pair_files": files(pair_paths), "item_files": files(item_paths)}


def consensus_audit(judged: DataFrame, annotators: list[Annotator], rules: ConsensusRules, exclusions: dict, sources: dict[str, dict]) -> dict:
    """What a consumer needs to check a consensus: counts, means, thresholds, annotators and exclusions.

    ``sources`` has model, score_sha256 and gate_sha256 of each annotator; the annotators count as
    independent if none of these is shared.  All figures come from one aggregate and one count per reason.
    """
    names = [a.name for a in annotators]
    if set(sources) != set(names):
        raise ValueError("sources and annotators differ")
    total = judged.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("accepted").alias("accepted_rows"), F.avg(F.when(F.col("accepted"), F.col("consensus"))).alias("mean_target"), F.avg(F.when(F.col("accepted"), F.col("sample_weight"))).alias("mean_weight"),
        *[F.avg(f"p_{n}").alias(f"mean_p_{n}") for n in names], *[F.avg(f"gap_{n}").alias(f"mean_gap_{n}") for n in names],
    ).head().asDict()
    reasons = {r[0]: r[1] for r in judged.select(F.explode("reasons").alias("r")).groupBy("r").count().collect()}
    labels = {str(r[0]): r[1] for r in judged.where("accepted").groupBy("label").count().collect()}
    independent = all(len({s.get(k) for s in sources.values()}) == len(sources) and all(s.get(k) for s in sources.values()) for k in ("model", "score_sha256", "gate_sha256"))
    return {
        "counts": total, "reasons": reasons, "labels": labels, "thresholds": {k: getattr(rules, k) for k in rules.__dataclass_fields__}, "annotators": {a.name: {"ap": a.ap, "constant_ap": a.constant_ap} | sources[a.name] for a in annotators},
        "exclusions": exclusions, "independent": independent, "independent_annotators": len(names) if independent else 0,
    }


def contract_faults(stored: DataFrame, annotators: list[Annotator], rules: ConsensusRules, banned_pairs: DataFrame | None = None, banned_ids: DataFrame | None = None, tolerance: float = 3e-5) -> DataFrame:
    """One row: what is wrong with a stored table of accepted pairs, recomputed from its own p_<name> and gap_<name>.

    Counts of rows whose target, spread, gap, number of confident annotators, quality or weight
    is not the recomputed one, whose label disagrees with the target, that break a threshold
    of acceptance, lack a category, repeat a pair, or touch what is excluded.
    """
    again = stored.withColumns({f"_{k}": v for k, v in consensus_columns(annotators, rules).items()})
    again = again.withColumn("_quality", quality_column(annotators, rules, F.col("_consensus"), F.col("_spread"), F.col("_max_gap")))
    far = lambda own, new: ~F.coalesce(F.abs(F.col(own) - new) <= tolerance, F.lit(False))
    weight = F.least(F.greatest(rules.weight_scale * F.col("_quality"), F.lit(rules.min_weight)), F.lit(rules.max_weight))
    unsure = (F.col("_consensus") > rules.negative) & (F.col("_consensus") < rules.positive)
    bad: dict[str, Column] = {
        "target_wrong": far("target", F.col("_consensus")), "spread_wrong": far("spread", F.col("_spread")), "max_gap_wrong": far("max_gap", F.col("_max_gap")),
        "confident_wrong": ~F.col("confident").eqNullSafe(F.col("_confident")), "quality_wrong": far("quality", F.col("_quality")), "weight_wrong": far("sample_weight", weight),
        "label_wrong": ~F.col("label").eqNullSafe((F.col("target") >= 0.5).cast("int")),
        "not_acceptable": unsure | (F.col("_spread") > rules.max_spread + 2e-6) | F.col("_conflicting") | (F.col("_max_gap") > rules.max_order_gap + 2e-6) | (F.col("_confident") < rules.min_confident),
        "no_category": F.col("category").isNull(),
    }
    counts = again.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in bad.items()], F.count(F.lit(1)).alias("total"))
    pairs = stored.groupBy(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")))  # one row each
    if banned_pairs is not None:
        counts = counts.join(pairs.join(pair_keys(banned_pairs), ["lo", "hi"], "left_semi").agg(F.count(F.lit(1)).alias("excluded_pairs")))
    if banned_ids is not None:
        counts = counts.join(endpoints(stored).join(banned_ids.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("excluded_ids")))
    return counts
