"""Problem 5: one ranking from several differently-scaled scores, by reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import competition_rank, ordinal

#: The usual constant of reciprocal rank fusion.
RRF_CONSTANT = 60


def _valid(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), c)


def pair_scores(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(id1, id2, ab, ba, votes): one row per distinct pair of ``candidates``, id1 < id2.

    A score is the largest of its valid values (no null, no NaN) over the pair's rows; in a
    row with swapped ids ab and ba change places.  ``votes`` is the target of ``matches`` in
    nearest ninths, taken over either order and from targets within 0..1 only.
    """
    swapped = F.col("id1") > F.col("id2")
    ordered = candidates.where("id1 is not null and id2 is not null").select(
        F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"),
        F.when(swapped, F.col("teacher_ba")).otherwise(F.col("teacher_ab")).alias("ab"), F.when(swapped, F.col("teacher_ab")).otherwise(F.col("teacher_ba")).alias("ba"),
    )
    pairs = ordered.groupBy("id1", "id2").agg(F.max(_valid(F.col("ab"))).alias("ab"), F.max(_valid(F.col("ba"))).alias("ba"))
    target = _valid(F.col("target"))
    votes = matches.where(target.between(0, 1)).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.rint(target * 9).alias("v"))
    return pairs.join(votes.groupBy("id1", "id2").agg(F.max("v").alias("votes")), ["id1", "id2"], "left")


def fuse(items: DataFrame, keys: list[str], scores: list[str], constant: int = RRF_CONSTANT) -> DataFrame:
    """``items`` with ``fused`` and ``position`` (1 is best; ties by ``keys``).

    Every score is ranked by itself (higher is better, equal values share a rank), so scale,
    shape and outliers have no weight.  An item without a score gets nothing for it.
    """
    ranked = items
    for s in scores:
        ranked = competition_rank(ranked, s, f"rank_{s}")
    parts = [F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(f"rank_{s}")), F.lit(0.0)) for s in scores]
    fused = ranked.withColumn("fused", reduce(lambda a, b: a + b, parts))
    return ordinal(fused, [F.col("fused").desc(), *[F.col(k) for k in keys]], "position")
