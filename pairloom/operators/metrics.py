"""Average precision, ranks within groups and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import cumulative_in_groups


def average_precision(scored: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, n, pos, ap): step-wise average precision over distinct thresholds.

    Rows are first aggregated to one per group and score; running sums span partitions, so a
    group that holds a third of all rows is not sorted in one task.
    """
    steps = scored.groupBy(group, score).agg(F.sum(F.col(label).cast("double")).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = cumulative_in_groups(steps, group, [F.col(score).desc()], {"tp_upto": F.col("tp"), "n_upto": F.col("n")})
    part = F.try_divide(F.col("tp_upto"), F.col("n_upto")) * F.col("tp")
    sums = run.groupBy(group).agg(F.sum("n").alias("n"), F.sum("tp").alias("pos"), F.sum(part).alias("part"))
    return sums.select(group, "n", F.col("pos").cast("bigint").alias("pos"), F.try_divide("part", "pos").alias("ap"))


def macro_average_precision(per_group: DataFrame, eligibility: str, min_pos: int = 5, min_rows: int = 0) -> DataFrame:
    """(groups, macro_ap) over the groups that count.

    ``eligibility``: 'evaluation' min_pos <= pos < n; 'training' pos > 0; 'labelling' 0 < pos < n.  With ``min_rows`` the mean
    is null unless all groups have more rows than that.
    """
    rule = {"evaluation": (F.col("pos") >= min_pos) & (F.col("pos") < F.col("n")), "training": F.col("pos") > 0, "labelling": (F.col("pos") > 0) & (F.col("pos") < F.col("n"))}[eligibility]
    counted = per_group.agg(F.count_if(rule).alias("groups"), F.avg(F.when(rule, F.col("ap"))).alias("macro_ap"), F.sum("n").alias("_rows"))
    return counted.select("groups", F.when(F.coalesce("_rows", F.lit(0)) > min_rows, F.col("macro_ap")).alias("macro_ap")) if min_rows else counted.select("groups", "macro_ap")


def percentile_rank(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """``df`` with the rank / n of ``score`` within ``group``, ties averaged.

    Ranks are computed over distinct scores and joined back, not by a window over all rows.
    """
    values = df.groupBy(group, score).agg(F.count(F.lit(1)).alias("_n"))
    sizes = df.groupBy(F.col(group).alias("_h")).agg(F.count(F.lit(1)).alias("_size"))
    run = cumulative_in_groups(values, group, [F.col(score)], {"_upto": F.col("_n")}).join(sizes, F.col(group).eqNullSafe(F.col("_h")))
    rank = ((F.col("_upto") - F.col("_n") + 1 + F.col("_upto")) / 2) / F.col("_size")
    ranks = run.select(F.col(group).alias("_g"), F.col(score).alias("_s"), rank.alias(name))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(score).eqNullSafe(F.col("_s"))).drop("_g", "_s")
