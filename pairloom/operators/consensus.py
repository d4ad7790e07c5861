"""Merging several annotators' scores into audited soft labels."""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scores import clip, confidence, total
from pairloom.operators.metrics import percentile_rank


@dataclass(frozen=True)
class Annotator:
    """An annotator with the average precision of its gate and that of a constant score."""

    name: str
    ap: float
    constant_ap: float
    multiplier: float = 1.0


@dataclass(frozen=True)
class ConsensusRules:
    """Thresholds of the consensus; related ones are checked."""

    positive: float = 0.72
    negative: float = 0.28
    max_spread: float = 0.25
    vote_negative: float = 0.28
    vote_positive: float = 0.72
    min_confident: int = 2
    max_order_gap: float = 0.15
    order_scale: float = 0.1
    confidence_floor: float = 0.05
    gate_floor: float = 0.01
    gate_power: float = 1.0
    min_gate_ap: float = 0.58
    rule_veto: float = 0.5
    negative_veto_rank: float = 0.95
    positive_veto_rank: float = 0.05
    max_scorer_gap: float = 0.15
    weight_scale: float = 1.0
    min_weight: float = 0.2
    max_weight: float = 1.5

    def __post_init__(self) -> None:
        if not 0 <= self.negative < 0.5 < self.positive <= 1:
            raise ValueError("thresholds must lie on either side of one half")
        if not 0 <= self.vote_negative < self.vote_positive <= 1:
            raise ValueError("vote thresholds must be ordered")
        if self.order_scale <= 0 or self.max_order_gap < 0 or not 0 < self.min_weight <= self.max_weight:
            raise ValueError("scales and weights must be positive")


def reliability(annotators: list[Annotator], rules: ConsensusRules) -> dict[str, float]:
    """Normalised weight of each annotator: lift over the constant score, floored, to a power."""
    lift = {a.name: max((a.ap - a.constant_ap) / max(1e-9, 1 - a.constant_ap), rules.gate_floor) ** rules.gate_power * a.multiplier for a in annotators}
    whole = sum(lift.values())
    return {n: v / whole for n, v in lift.items()}


def consensus_columns(annotators: list[Annotator], rules: ConsensusRules) -> dict[str, Column]:
    """Named columns over p_<name> (probability) and gap_<name> (order gap)."""
    names = [a.name for a in annotators]
    share = reliability(annotators, rules)
    p, gap = {n: F.col(f"p_{n}") for n in names}, {n: F.col(f"gap_{n}") for n in names}
    effective = {n: share[n] * (rules.confidence_floor + confidence(p[n])) * F.exp(-gap[n] / rules.order_scale) for n in names}
    extreme = lambda f, cs: f(*cs) if len(cs) > 1 else cs[0]
    low, high = extreme(F.least, list(p.values())), extreme(F.greatest, list(p.values()))
    mean = total([share[n] * p[n] for n in names])
    sure = [((p[n] <= rules.vote_negative) | (p[n] >= rules.vote_positive)).cast("int") for n in names]
    against = extreme(F.greatest, [p[n] <= rules.vote_negative for n in names]) & extreme(F.greatest, [p[n] >= rules.vote_positive for n in names])
    return {
        "consensus": total([effective[n] * p[n] for n in names]) / total(list(effective.values())),
        "spread": high - low,
        "weighted_std": F.sqrt(total([share[n] * (p[n] - mean) * (p[n] - mean) for n in names])),
        "max_gap": extreme(F.greatest, list(gap.values())),
        "confident": total(sure),
        "conflicting": against,
    }


# The reasons for which a pair is not accepted, in their order.
REASONS = [
    "consensus_uncertain", "teacher_disagreement", "order_instability", "insufficient_confident_teachers", "rule_positive_veto", "cross_encoder_negative_veto", "cross_encoder_positive_veto",
]


def scorer_ranks(scored: DataFrame, scorers: list[str], group: str) -> DataFrame:
    """``scored`` with rank_<s>: the percentile rank of every scorer's column within ``group``, ties averaged.

    The scorers' columns s, s_ab, s_ba and s_gap must be finite and agree with each other, and the group
    complete; scorer_faults counts what does not.
    """
    return reduce(lambda df, s: percentile_rank(df, group, s, f"rank_{s}"), scorers, scored)


def scorer_faults(scored: DataFrame, scorers: list[str], group: str, tolerance: float = 2e-5) -> DataFrame:
    """One row: rows without a group, and per scorer rows outside 0..1, with a wrong mean, or with a wrong gap."""
    bad = {"no_group": F.col(group).isNull()}
    for s in scorers:
        ab, ba, own, gap = F.col(f"{s}_ab"), F.col(f"{s}_ba"), F.col(s), F.col(f"{s}_gap")
        bad[f"{s}_range"] = ~F.coalesce(own.between(0, 1) & ~F.isnan(own), F.lit(False))
        bad[f"{s}_mean"] = ~F.coalesce(F.abs(own - (ab + ba) / 2) <= tolerance, F.lit(False))
        bad[f"{s}_order"] = ~F.coalesce(F.abs(gap - F.abs(ab - ba)) <= tolerance, F.lit(False))
    return scored.agg(*[F.count_if(c).alias(n) for n, c in bad.items()], F.count(F.lit(1)).alias("total"))


def rank_vetoes(scorers: list[str], rules: ConsensusRules) -> tuple[Column, Column]:
    """Whether all scorers, each stable under a swap, rank a pair so high that it can't be negative, or so low that it can't be positive.

    Over the columns rank_<s> and <s>_gap; without a scorer nothing is vetoed.
    """
    if not scorers:
        return F.lit(False), F.lit(False)
    each = lambda test: reduce(lambda a, b: a & b, [(F.col(f"{s}_gap") <= rules.max_scorer_gap) & test(F.col(f"rank_{s}")) for s in scorers])
    return each(lambda r: r >= rules.negative_veto_rank), each(lambda r: r <= rules.positive_veto_rank)


def quality_column(annotators: list[Annotator], rules: ConsensusRules, consensus: Column, spread: Column, max_gap: Column) -> Column:
    """Quality of a consensus: certainty, agreement, stability under a swap, and strength of the annotators' gates."""
    share = reliability(annotators, rules)
    weighted_ap = sum(share[a.name] * a.ap for a in annotators)
    gate = min(1.0, max(0.0, (weighted_ap - rules.min_gate_ap) / max(1e-9, 1 - rules.min_gate_ap)))
    return (0.25 + 0.75 * confidence(consensus)) * (0.5 + 0.5 * clip(1 - spread, 0.0, 1.0)) * F.exp(-max_gap / rules.order_scale) * (0.75 + 0.25 * gate)


def decide(scored: DataFrame, annotators: list[Annotator], rules: ConsensusRules, conflict: Column | None = None, scorers: list[str] | None = None) -> DataFrame:
    """``scored`` with the consensus columns, ``label``, ``reasons`` (ordered array), ``accepted``, ``quality`` and ``sample_weight``.

    ``conflict`` is the strength of a rule against a positive label, ``scorers`` name ranked
    scorers (see scorer_ranks) that can veto either label.
    """
    df = scored.withColumns(consensus_columns(annotators, rules)).withColumn("label", (F.col("consensus") >= rules.positive).cast("int"))
    high, low = rank_vetoes(scorers or [], rules)
    certain = (F.col("consensus") >= rules.positive) | (F.col("consensus") <= rules.negative)
    flags = [
        ~certain,
        (F.col("spread") > rules.max_spread) | F.col("conflicting"),
        F.col("max_gap") > rules.max_order_gap,
        F.col("confident") < rules.min_confident,
        (F.col("label") == 1) & ((conflict if conflict is not None else F.lit(0.0)) >= rules.rule_veto),
        (F.col("consensus") <= rules.negative) & high,
        (F.col("label") == 1) & low,
    ]
    reasons = F.array_compact(F.array(*[F.when(f, F.lit(r)) for f, r in zip(flags, REASONS, strict=True)]))
    quality = quality_column(annotators, rules, F.col("consensus"), F.col("spread"), F.col("max_gap"))
    df = df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).withColumn("quality", quality)
    return df.withColumn("sample_weight", clip(rules.weight_scale * F.col("quality"), rules.min_weight, rules.max_weight))


def rule_conflict(flags: list[str], present: list[str]) -> Column:
    """The largest of the rule flags that the table has; 0 without any."""
    own = [F.col(f) for f in flags if f in present]
    return F.greatest(F.lit(0.0), *own) if own else F.lit(0.0)


def first_present(columns: list[str], present: list[str]) -> str | None:
    """The first of ``columns`` that the table has."""
    return next((c for c in columns if c in present), None)


def align(tables: dict[str, DataFrame], columns: list[str], shared: list[str] | None = None, strict: bool = True, tolerance: float = 1e-7) -> DataFrame:
    """(lo, hi, <shared>, <column>_<name>...): the tables of any number of annotators, one row per unordered pair.

    All tables are gathered by one shuffle on the pair.  ``shared`` columns must be the same in all
    (numbers up to ``tolerance``); nulls equal nulls.  With ``strict`` a table that lacks or repeats a pair, or
    differs in a shared column, raises ValueError with the counts; without, such pairs are left out.
    """
    shared, names = shared or [], list(tables)
    parts = [df.select("lo", "hi", F.lit(n).alias("_who"), *columns, *shared) for n, df in tables.items()]
    own = [F.max(F.when(F.col("_who") == n, F.col(c))).alias(f"{c}_{n}") for n in names for c in columns]
    least, most = [F.min(c).alias(f"_min_{c}") for c in shared], [F.max(c).alias(f"_max_{c}") for c in shared]
    there = [F.count_if(F.col("_who") == n).alias(f"_n_{n}") for n in names]
    some = [F.count(c).alias(f"_some_{c}") for c in shared]
    met = reduce(DataFrame.unionByName, parts).groupBy("lo", "hi").agg(*own, *least, *most, *there, *some)
    lacking = {f"{n}_missing": F.col(f"_n_{n}") == 0 for n in names} | {f"{n}_repeated": F.col(f"_n_{n}") > 1 for n in names}
    kinds = dict(parts[0].dtypes)

    def differs(c: str) -> Column:
        gap = F.abs(F.col(f"_max_{c}") - F.col(f"_min_{c}")) > tolerance if kinds[c] in ("double", "float") else F.col(f"_max_{c}") != F.col(f"_min_{c}")
        return F.coalesce(gap, F.lit(False)) | ((F.col(f"_some_{c}") > 0) & (F.col(f"_some_{c}") < reduce(lambda a, b: a + b, [F.col(f"_n_{n}") for n in names])))

    faults = lacking | {f"{c}_differs": differs(c) for c in shared}
    if strict:
        counts = met.agg(*[F.count_if(c).alias(n) for n, c in faults.items()]).head().asDict()
        if any(counts.values()):
            raise ValueError(f"annotators disagree: { {k: v for k, v in counts.items() if v} }")
    sound = met.where(~reduce(lambda a, b: a | b, faults.values()))
    return sound.select("lo", "hi", *[F.col(f"_max_{c}").alias(c) for c in shared], *[f"{c}_{n}" for n in names for c in columns])


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): how many unordered pairs one table has and the other lacks; one full outer join."""
    a, b = left.select("lo", "hi").distinct().withColumn("_a", F.lit(1)), right.select("lo", "hi").distinct().withColumn("_b", F.lit(1))
    return a.join(b, ["lo", "hi"], "full").agg(F.count_if(F.expr("_b is null")).alias("only_left"), F.count_if(F.expr("_a is null")).alias("only_right"))


def content_duplicates(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """``pairs`` (fp1, fp2, ...) with ``duplicate``: an earlier row in ``order`` has the same unordered contents."""
    w = Window.partitionBy(F.least("fp1", "fp2"), F.greatest("fp1", "fp2")).orderBy(*order)
    return pairs.withColumn("duplicate", F.row_number().over(w) > 1)


def normalise_streams(pool: DataFrame, stream: str, weight: str, fractions: dict[str, float]) -> DataFrame:
    """``pool`` with ``weight`` scaled per stream so that streams have the given shares of a total mass of one per row.

    Sums are aggregated to one row per stream and joined back by broadcast.
    """
    if abs(sum(fractions.values()) - 1) > 1e-9 or min(fractions.values()) <= 0:
        raise ValueError("fractions must be positive and sum to 1")
    sums = pool.groupBy(stream).agg(F.sum(weight).alias("_mass"), F.count(F.lit(1)).alias("_n"))
    wanted = F.coalesce(*[F.when(F.col(stream) == s, F.lit(f)) for s, f in fractions.items()])
    scale = sums.select(F.col(stream).alias("_s"), (F.sum("_n").over(Window.partitionBy()) * wanted / F.col("_mass")).alias("_scale"))
    return pool.join(F.broadcast(scale), F.col(stream) == F.col("_s")).withColumn(weight, F.col(weight) * F.col("_scale")).drop("_s", "_scale")
