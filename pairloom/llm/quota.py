"""Problem 7: a sample that matches target category proportions.

Counts per stratum are aggregated in the cluster, quotas are allotted on the driver over the
(given, few) strata, and the rows with the smallest random keys of each stratum are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.splits import category_key
from pairloom.operators.sampling import largest_remainder, random_key, smallest_per_group
from pairloom.workspace import cut


def labelled_pairs(matches: DataFrame, items: DataFrame) -> DataFrame:
    """(id1, id2, votes, cat): distinct pairs, id1 < id2, with their highest nearest ninth and the category key of id1's card.

    Null, NaN and out-of-range targets, self-pairs and pairs whose smaller id has no card with
    a category are left out.
    """
    sound = matches.where("id1 is not null and id2 is not null and id1 <> id2 and target is not null and not isnan(target) and target between 0 and 1")
    pairs = sound.groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.max(F.rint(F.col("target") * 9)).cast("int").alias("votes"))
    cards = items.where("id is not null and category is not null").groupBy(F.col("id").alias("id1")).agg(F.min(category_key("category")).alias("cat"))
    return pairs.join(cards, "id1").select("id1", "id2", "votes", "cat")


def strata(pairs: DataFrame, targets: DataFrame, fraction: float = 0.1) -> tuple[DataFrame, int]:
    """The strata with ``available``, ``wanted``, ``quota`` and ``shortfall``, and the sample size S.

    ``wanted`` is the larger of min_rows and target_share x S.  Quotas follow the shares by
    largest remainder, with min_rows as floors and what is available as caps.
    """
    spark = pairs.sparkSession
    counts = pairs.groupBy("cat", "votes").agg(F.count(F.lit(1)).alias("n"))
    by = {(r.cat, r.votes): r.n for r in counts.join(F.broadcast(targets.select(category_key("category").alias("cat")).distinct()), "cat", "left_semi").collect()}  # strata given x ten votes
    total = pairs.count()
    size = int(total * fraction + 1e-9)
    rows = targets.orderBy("category", "votes_from").collect()
    key = {r.category: r.k for r in targets.select("category", category_key("category").alias("k")).distinct().collect()}
    have = [sum(by.get((key[r.category], v), 0) for v in range(r.votes_from, r.votes_to + 1)) for r in rows]
    quotas = largest_remainder([r.target_share for r in rows], size, [r.min_rows for r in rows], have)
    table = [
        (r.category, key[r.category], int(r.votes_from), int(r.votes_to), float(r.target_share), int(r.min_rows), h, max(float(r.min_rows), r.target_share * size), q)
        for r, h, q in zip(rows, have, quotas, strict=True)
    ]
    schema = "category string, cat string, votes_from int, votes_to int, target_share double, min_rows bigint, available bigint, wanted double, quota bigint"
    return spark.createDataFrame(table, schema).withColumn("shortfall", F.greatest(F.col("wanted") - F.col("available"), F.lit(0.0))), size


def shortfalls(matches: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, votes_from): strata with fewer pairs than wanted."""
    table, _ = strata(cut(labelled_pairs(matches, items), "pairs"), targets)
    return table.where("available < wanted").select("category", F.col("votes_from").cast(targets.schema["votes_from"].dataType).alias("votes_from"))


def quota_sample(matches: DataFrame, items: DataFrame, targets: DataFrame, seed: str = "p7") -> DataFrame:
    """(id1, id2, votes, category, votes_from): the sample."""
    pairs = cut(labelled_pairs(matches, items), "pairs")
    table, _ = strata(pairs, targets)
    within = (pairs.cat == F.col("s.cat")) & pairs.votes.between(F.col("s.votes_from"), F.col("s.votes_to"))
    open_rows = pairs.join(F.broadcast(table.alias("s")), within).select("id1", "id2", "votes", "category", "votes_from", "quota")  # one row per given stratum
    keyed = open_rows.withColumn("key", random_key(seed, F.col("id1"), F.col("id2")))
    return smallest_per_group(keyed, ["category", "votes_from"], "key", "quota").select("id1", "id2", "votes", "category", "votes_from")
