"""Pair algebra: canonical pairs, exclusions, overrides, duplicates, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``pairs`` with the smaller and the larger id."""
    return pairs.withColumn(lo, F.least("id1", "id2")).withColumn(hi, F.greatest("id1", "id2"))


def pair_keys(pairs: DataFrame) -> DataFrame:
    """(lo, hi): the distinct unordered pairs."""
    return canonical(pairs.select("id1", "id2")).select("lo", "hi").distinct()


def violations(pairs: DataFrame) -> DataFrame:
    """One row: how many rows have a null id or pair a card with itself."""
    return pairs.agg(F.count_if(F.col("id1").isNull() | F.col("id2").isNull()).alias("null_ids"), F.count_if(F.col("id1") == F.col("id2")).alias("self_pairs"), F.count(F.lit(1)).alias("total"))


def endpoints(*tables: DataFrame) -> DataFrame:
    """(id): distinct non-null ids of either column; one scan and one shuffle a table."""
    out = None
    for t in tables:
        ids = t.select(F.explode(F.array("id1", "id2")).alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return out.where("id is not null").distinct()


def exclude_pairs(pairs: DataFrame, banned: DataFrame) -> DataFrame:
    """Rows whose unordered pair is not in ``banned``."""
    keys = pair_keys(banned).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    return pairs.join(keys, (F.least("id1", "id2") == F.col("_lo")) & (F.greatest("id1", "id2") == F.col("_hi")), "left_anti")


def exclude_entities(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows neither of whose cards is in ``ids``."""
    for c in ("id1", "id2"):
        pairs = pairs.join(ids.select(F.col("id").alias("_id")), F.col(c) == F.col("_id"), "left_anti")
    return pairs


def attach(pairs: DataFrame, cards: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of both cards, suffixed 1 and 2; null where a card is missing."""
    for n in ("1", "2"):
        side = cards.select(F.col("id").alias(f"_id{n}"), *[F.col(c).alias(f"{c}{n}") for c in columns])
        pairs = pairs.join(side, F.col(f"id{n}") == F.col(f"_id{n}"), "left").drop(f"_id{n}")
    return pairs


def with_endpoints(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows both of whose cards are in ``ids``."""
    for c in ("id1", "id2"):
        pairs = pairs.join(ids.select(F.col("id").alias("_id")), F.col(c) == F.col("_id"), "left_semi")
    return pairs


def lookup(pairs: DataFrame, cards: DataFrame, column: str, on_missing: str) -> DataFrame:
    """``pairs`` with ``column`` of both cards; a missing card gives an empty text, drops the pair, or raises."""
    if on_missing not in ("empty", "drop", "error"):
        raise ValueError(f"on_missing: {on_missing!r}")
    marked = attach(pairs, cards.withColumn("_there", F.lit(True)), column, "_there")
    missing = F.col("_there1").isNull() | F.col("_there2").isNull()
    if on_missing == "drop":
        return marked.where(~missing).drop("_there1", "_there2")
    if on_missing == "error":
        checked = F.when(missing, F.raise_error(F.lit("a pair names a card that the catalogue lacks"))).otherwise(F.col(f"{column}1"))
        return marked.withColumn(f"{column}1", checked).drop("_there1", "_there2")
    texts = {f"{column}{n}": F.coalesce(F.col(f"{column}{n}"), F.lit("")) for n in (1, 2)}
    return marked.withColumns(texts).drop("_there1", "_there2")


def override(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of ``base`` whose unordered pair ``extra`` lacks, and all rows of ``extra``; same columns."""
    return exclude_pairs(base, extra).unionByName(extra.select(*base.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_cards(items: DataFrame) -> DataFrame:
    """One row per id: the first delivery.  An aggregate, not a window: it combines before the shuffle."""
    rest = [c for c in items.columns if c not in ("id", "loaded_at")]
    if not rest:
        return items.where("id is not null").select("id").distinct()
    first = F.min_by(F.struct(*rest), F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp")))
    return items.where("id is not null").groupBy("id").agg(first.alias("_c")).select("id", *[F.col(f"_c.{c}").alias(c) for c in rest])


def category_faults(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: pairs of two categories, with a card that has none, and whose own ``category`` is not that of their cards."""
    both = attach(pairs, cards, "category")
    crossed, unknown = F.col("category1") != F.col("category2"), F.expr("category1 is null or category2 is null")
    wrong = ~F.col("category").eqNullSafe(F.col("category1"))
    return both.agg(F.count_if(crossed).alias("crossed"), F.count_if(unknown).alias("unknown"), F.count_if(wrong & ~unknown).alias("misdeclared"), F.count(F.lit(1)).alias("total"))


def fingerprint_faults(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: pairs that store item_fp1, item_fp2 and whose cards lack a fingerprint, or have another one."""
    both = attach(pairs, cards, "fp")
    missing = F.expr("fp1 is null or fp2 is null")
    other = ~(F.col("fp1").eqNullSafe(F.col("item_fp1")) & F.col("fp2").eqNullSafe(F.col("item_fp2")))
    return both.agg(F.count_if(missing).alias("missing"), F.count_if(other & ~missing).alias("mismatched"), F.count(F.lit(1)).alias("total"))


def sound(matches: DataFrame) -> DataFrame:
    """Rows with two different cards and a target within 0..1."""
    return matches.where("id1 is not null and id2 is not null and id1 <> id2 and target is not null and not isnan(target) and target between 0 and 1")


def weak_pairs(matches: DataFrame) -> DataFrame:
    """(id1, id2, target, votes): one row per unordered pair of sound rows, id1 < id2, with its highest target."""
    rows = sound(matches).groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.max("target").alias("target"))
    return rows.withColumn("votes", F.rint(F.col("target") * 9).cast("int"))
