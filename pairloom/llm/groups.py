"""Problem 3: consolidating pairwise matches into groups.

The giant component is peeled off by frontier joins from the vertex of highest degree; what
it leaves is labelled by minimum propagation over a graph that is contracted in every round.
Rounds write their tables and drop those before, so lineage and disk stay bounded and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.graph import propagate
from pairloom.workspace import cut, write_table


def confident_edges(matches: DataFrame, min_votes: int = 8) -> DataFrame:
    """(a, b), a < b: pairs with at least ``min_votes`` of nine votes in any of their rows, either order.

    Null, NaN and out-of-range targets, null ids and self-pairs don't count.
    """
    sound = matches.where("id1 is not null and id2 is not null and id1 <> id2 and target is not null and not isnan(target) and target between 0 and 1")
    return sound.where(F.rint(F.col("target") * 9) >= min_votes).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _peel(both: DataFrame, max_frontiers: int) -> tuple[DataFrame | None, bool]:
    """(a): the vertices reached from the vertex of highest degree, and whether that is its whole component.

    Every frontier is written once; those reached are the union of all.
    """
    hub = both.groupBy("a").count().orderBy(F.desc("count"), "a").select("a").head()
    if hub is None:
        return None, True
    seen = [write_table(both.sparkSession.createDataFrame([(hub.a,)], both.select("a").schema), "frontier")]
    reached = seen[0].df
    for _ in range(max_frontiers):
        near = both.join(seen[-1].df, "a", "left_semi").select(F.col("b").alias("a")).distinct().join(reached, "a", "left_anti")
        step = write_table(near, "frontier")
        if step.df.isEmpty():
            step.drop()
            return reached, True
        seen.append(step)
        reached = reached.unionByName(step.df)
    return reached, False


def components(edges: DataFrame, max_frontiers: int = 12) -> DataFrame:
    """(node, label): connected components of ``edges`` (a, b); ``label`` is the smallest node.

    Repeated edges, either order and self-loops are harmless; null ends are ignored; an empty
    table gives an empty result.  A giant component of larger diameter than ``max_frontiers`` is contracted
    to one vertex after that many frontiers and finished by propagation.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    both = _both_ways(edges)
    reached, whole = _peel(both, max_frontiers)
    if reached is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    smallest = reached.agg(F.min("a").alias("m")).head().m
    giant = reached.select(F.col("a").alias("node"), F.lit(smallest).cast(edges.schema["a"].dataType).alias("label"))
    if whole:
        return giant.unionByName(propagate(edges.join(reached, "a", "left_anti")))
    ends = reached.withColumn("in", F.lit(True))
    left = edges.join(ends.withColumnRenamed("in", "in_a"), "a", "left").join(ends.select(F.col("a").alias("b"), F.col("in").alias("in_b")), "b", "left")
    one = F.lit(smallest)
    contracted = left.select(F.when(F.col("in_a"), one).otherwise(F.col("a")).alias("a"), F.when(F.col("in_b"), one).otherwise(F.col("b")).alias("b")).where("a <> b")
    rest = cut(propagate(contracted), "rest")
    root = rest.where(F.col("node") == one).select("label").head()
    label = F.lit(root.label if root else smallest)
    return rest.unionByName(giant.where(F.col("node") != one) if root else giant).withColumn("label", F.when(F.col("label") == one, label).otherwise(F.col("label")))


def match_groups(matches: DataFrame, min_votes: int = 8) -> DataFrame:
    """(id, group_id) of every card tied by confident pairs."""
    return components(confident_edges(matches, min_votes)).select(F.col("node").alias("id"), F.col("label").alias("group_id"))
