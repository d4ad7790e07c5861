"""Global positions and ranks without a single-partition window.

Rows are range-partitioned, each partition sums on its own, and the offsets of the (few)
partitions are added.  A plain ``Window.orderBy`` would move all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.workspace import cut


def cumulatives(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name of ``values``, the sum of that column over all rows up to this one in ``order``.

    ``order`` should be total: ties would fall into one partition and get any order.
    """
    inner = {name: f"_v{i}" for i, name in enumerate(values)}
    staged = df.withColumns({inner[n]: v for n, v in values.items()})
    ranged = cut(staged.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_p").agg(*[F.sum(c).alias(c) for c in inner.values()])  # one row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_p").alias("_at"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c}") for c in inner.values()])
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_c{c}": F.sum(c).over(inside) for c in inner.values()}).join(F.broadcast(offsets), F.col("_p") == F.col("_at"))
    return summed.select(*df.columns, *[(F.col(f"_c{c}") + F.col(f"_o{c}")).alias(n) for n, c in inner.items()])


def cumulative(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one in the total ``order``."""
    return cumulatives(df, order, {name: value})


def cumulative_in_groups(df: DataFrame, group: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """As cumulatives, but starting anew in each ``group``; a group may span partitions, so a huge one costs no single task.

    What came before a group is known from the groups' totals, one row each.
    """
    summed = cumulatives(df, [F.col(group), *order], values)
    names = list(values)
    totals = df.groupBy(group).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values.values())])
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("_g"), *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(names))])
    joined = summed.join(starts, F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*df.columns, *[(F.col(n) - F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)])


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its position 1..n in the total ``order``."""
    return cumulative(df, order, F.lit(1).cast("bigint"), name)


def exact_quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """The exact quantiles of ``value`` at ``shares``, interpolated between neighbours; None for a table without values.

    Values are counted and their counts summed over range partitions; no task holds all of them.
    """
    counts = df.select(value.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = cut(cumulative(counts, [F.col("_v")], F.col("_n"), "_upto"), "quantiles")
    total = upto.agg(F.max("_upto").alias("n")).head().n
    if not total:
        return [None] * len(shares)
    places = sorted({p for s in shares for p in (int(s * (total - 1)), min(total - 1, int(s * (total - 1)) + 1))})
    at = upto.where(" or ".join(f"(_upto - _n <= {p} and _upto > {p})" for p in places)).select("_v", (F.col("_upto") - F.col("_n")).alias("lo"), F.col("_upto").alias("hi")).collect()  # two rows a quantile at most
    found = {p: next(float(r._v) for r in at if r.lo <= p < r.hi) for p in places}
    out = []
    for s in shares:
        low = int(s * (total - 1))
        part = s * (total - 1) - low
        out.append(found[low] + part * (found[min(total - 1, low + 1)] - found[low]))
    return out


def competition_rank(df: DataFrame, score: str, name: str, descending: bool = True) -> DataFrame:
    """``df`` with ``name``: 1 + the number of rows with a better ``score``; equal scores share a rank.

    Rows whose score is null or NaN get no rank (null).
    """
    valid = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    values = valid.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(score).desc() if descending else F.col(score).asc()
    ranks = cumulative(values, [order], F.col("_n"), "_upto").select(F.col(score).alias("_score"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    return df.join(ranks, F.when(~F.isnan(score), F.col(score)) == F.col("_score"), "left").drop("_score")
