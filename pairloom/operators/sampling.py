"""Deterministic samples and quotas.

Random order is the order of md5(seed | key): the same rows in any engine, on any cluster
and for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ranking import cumulative_in_groups


def random_key(seed: str, *parts: Column) -> Column:
    """md5 of the seed and the parts, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def portable_int(text: Column) -> Column:
    """The first 32 bits of md5(text) as a bigint, alike in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def smallest_per_group(df: DataFrame, groups: list[str], key: str, quota: str) -> DataFrame:
    """The rows with the ``quota`` smallest ``key``s (hex digits, distinct) of each group.

    ``quota`` is a column that is equal within a group.  A histogram over the first three
    digits finds the digit range in which each group's quota ends; whole ranges below it are
    taken, and only rows of that range are sorted, 1/4096 of a group, so a group that holds
    a third of all rows is never sorted in one task.
    """
    cell = df.withColumn("_spg_cell", F.substring(key, 1, 3))
    counts = cell.groupBy(*groups, "_spg_cell").agg(F.count(F.lit(1)).alias("_spg_n"), F.max(quota).alias("_spg_q"))
    upto = Window.partitionBy(*groups).orderBy("_spg_cell").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.withColumn("_spg_room", F.col("_spg_q") - F.coalesce(F.sum("_spg_n").over(upto), F.lit(0))).where("_spg_room > 0").select(*[F.col(g).alias(f"_spg_g_{g}") for g in groups], F.col("_spg_cell").alias("_spg_c"), "_spg_room", "_spg_n")
    same = F.col("_spg_cell") == F.col("_spg_c")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_spg_g_{g}"))
    open_rows = cell.join(room, same)
    whole = open_rows.where("_spg_n <= _spg_room")
    last = open_rows.where("_spg_n > _spg_room").withColumn("_spg_r", F.row_number().over(Window.partitionBy(*groups, "_spg_cell").orderBy(key))).where("_spg_r <= _spg_room").drop("_spg_r")
    return whole.unionByName(last).select(*df.columns)


def top_per_group(df: DataFrame, group: str, score: str, ties: list[str], quota: str) -> DataFrame:
    """The rows with the ``quota`` largest ``score``s of each ``group``, equal scores in the order of ``ties``.

    Scores are counted first; whole scores above the one at which a group's quota ends are
    taken, and only the rows of that score are sorted.
    """
    counts = df.groupBy(group, score).agg(F.count(F.lit(1)).alias("_top_n"), F.max(quota).alias("_top_q"))
    upto = cumulative_in_groups(counts, group, [F.col(score).desc()], {"_top_upto": F.col("_top_n")})
    room = upto.select(F.col(group).alias("_top_g"), F.col(score).alias("_top_s"), "_top_n", (F.col("_top_q") - F.col("_top_upto") + F.col("_top_n")).alias("_top_room")).where("_top_room > 0")
    open_rows = df.join(room, F.col(group).eqNullSafe(F.col("_top_g")) & (F.col(score) == F.col("_top_s")))
    place = F.row_number().over(Window.partitionBy(group, score).orderBy(*ties))
    last = open_rows.where("_top_n > _top_room").withColumn("_top_place", place).where("_top_place <= _top_room").drop("_top_place")
    return open_rows.where("_top_n <= _top_room").unionByName(last).select(*df.columns)


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys."""
    one = rows.withColumn("_all", F.lit(1)).withColumn("_quota", F.lit(n).cast("bigint"))
    return smallest_per_group(one, ["_all"], key, "_quota").drop("_all", "_quota")


def shuffled(df: DataFrame, seed: str, *keys: str) -> DataFrame:
    """``df`` in an order given by the hash of ``seed`` and ``keys``: the same on any cluster."""
    return df.orderBy(random_key(seed, *[F.col(k) for k in keys]), *keys)


def largest_remainder(shares: list[float], total: int, floors: list[int], caps: list[int]) -> list[int]:
    """Integer quotas close to ``shares`` x ``total``, at least ``floors`` and at most ``caps``.

    Every part starts at its floor (or cap, if smaller).  What is left of ``total`` goes by
    largest remainder over the parts below their cap, again and again until it is used up or
    every cap is met.  Ties go to the earlier part.
    """
    quotas = [min(f, c) for f, c in zip(floors, caps, strict=True)]
    for _ in range(len(shares) + 1):
        left = total - sum(quotas)
        open_parts = [i for i, (q, c) in enumerate(zip(quotas, caps, strict=True)) if q < c]
        if left <= 0 or not open_parts:
            break
        wish = {i: max(0.0, shares[i] * total - quotas[i]) for i in open_parts}
        if not (whole := sum(wish.values())):
            wish = {i: shares[i] or 1e-12 for i in open_parts}
            whole = sum(wish.values())
        exact = {i: w * left / whole for i, w in wish.items()}
        given = {i: int(x) for i, x in exact.items()}
        for i in sorted(open_parts, key=lambda i: (given[i] - exact[i], i))[: left - sum(given.values())]:
            given[i] += 1
        for i, g in given.items():
            quotas[i] = min(caps[i], quotas[i] + g)
    return quotas
