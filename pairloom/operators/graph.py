"""Connected components, component-disjoint folds, transitive closure of confident pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import exclude_entities, exclude_pairs
from pairloom.operators.sampling import hash_sample, portable_int, random_key
from pairloom.workspace import cut, write_table


def propagate(edges: DataFrame) -> DataFrame:
    """(node, label) of every endpoint of ``edges`` (a, b): ``label`` is the smallest node of its component.

    Contraction.  In each round every node moves to the neighbour of lowest hash (or stays), then
    once more, and the edges are redrawn between the places moved to; edges within one place are
    dropped.  Hash order makes chains shrink by a constant factor too, so all rounds
    together cost a few times the first one, and the rounds end: the node of highest hash of
    a component is nobody's place.  The places are then looked up from the last round back to the first.
    Tables of a round are dropped as soon as the next one has been written.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, moves = write_table(ends, "edges"), []
    empty = left.df.isEmpty()
    while not empty:
        both = left.df.unionByName(left.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        best = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["n"].alias("place"))
        first = write_table(best, "moves")
        again = first.df.select(F.col("node").alias("at"), F.col("place").alias("further"))
        move = write_table(first.df.join(again, F.col("place") == F.col("at")).select("node", F.col("further").alias("place")), "moves")
        moves.append(move)
        to = lambda c: move.df.select(F.col("node").alias(c), F.col("place").alias(f"to_{c}"))
        drawn = left.df.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        later = write_table(drawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        first.drop()
        left.drop()
        left = later
        empty = left.df.isEmpty()
    left.drop()
    if not moves:
        return ends.select(F.col("a").alias("node"), F.col("a").alias("label"))
    root = moves[-1]
    for move in reversed(moves[:-1]):
        up = root.df.select(F.col("node").alias("at"), F.col("place").alias("root"))
        later = write_table(move.df.join(up, F.col("place") == F.col("at"), "left").select("node", F.coalesce("root", "place").alias("place")), "roots")
        root.drop()
        move.drop()
        root = later
    smallest = root.df.groupBy("place").agg(F.min("node").alias("label"))
    return root.df.join(smallest, "place").select("node", "label")


def pair_components(pairs: DataFrame) -> DataFrame:
    """(node, label) over the cards of ``pairs``; a card paired only with itself is its own component."""
    ends = pairs.where("id1 is not null and id2 is not null").select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    found = cut(propagate(ends), "components")
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("label")))


def banned_and_aliases(ids: DataFrame, cards: DataFrame, fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(id, stated, alias): banned cards, and whether they are stated by ``ids`` and have a content of ``fps`` (fp)."""
    same = cards.join(fps.select(fp).distinct(), fp, "left_semi").select("id", F.lit(True).alias("_alias"))
    both = ids.select("id", F.lit(True).alias("_stated")).distinct().join(same, "id", "full")
    return both.select("id", F.coalesce("_stated", F.lit(False)).alias("stated"), F.coalesce("_alias", F.lit(False)).alias("alias"))


def alias_edges(cards: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): every card tied to the smallest id with its content fingerprint (a star, not all pairs)."""
    first = cards.groupBy(fp).agg(F.min("id").alias("a"))
    return cards.join(first, fp).where("a <> id").select("a", F.col("id").alias("b"))


def fold_of(component, folds: int = 5, seed: str = "fold"):
    """Fold of a component, uniform and the same in any engine."""
    return F.pmod(portable_int(F.concat_ws("|", F.lit(seed), component.cast("string"))), F.lit(folds)).cast("int")


def kept_clusters(components: DataFrame, banned: DataFrame, smallest: int = 2, largest: int = 8) -> DataFrame:
    """(id, comp) of components of ``smallest`` to ``largest`` cards none of which is banned.

    Sizes are aggregated before the join, so a giant component costs one row.
    """
    sizes = components.groupBy("label").agg(F.count("node").alias("n")).where(F.col("n").between(smallest, largest)).select("label")
    held = components.join(banned.select(F.col("id").alias("node")), "node", "left_semi").select("label").distinct()
    return components.join(sizes, "label", "left_semi").join(held, "label", "left_anti").select(F.col("node").alias("id"), F.col("label").alias("comp"))


def transitive_positives(clusters: DataFrame, positives: DataFrame) -> DataFrame:
    """(id1, id2): pairs within a kept cluster that are no known positive (explicit negatives included)."""
    other = clusters.select(F.col("id").alias("id2"), "comp")
    inside = clusters.select(F.col("id").alias("id1"), "comp").join(other, "comp").where("id1 < id2").select("id1", "id2")
    return exclude_pairs(inside, positives)


def transitive_negatives(clusters: DataFrame, positives: DataFrame, negatives: DataFrame, banned: DataFrame) -> DataFrame:
    """(id1, id2): negative pairs carried over to all members of the clusters they touch.

    A negative within one cluster, or with neither end in a cluster, carries nothing; an end
    outside counts as a cluster of its own.  Known pairs and banned cards are left out.
    """
    comp = lambda c, to: clusters.select(F.col("id").alias(c), F.col("comp").alias(to))
    ends = negatives.select("id1", "id2").join(comp("id1", "c1"), "id1", "left").join(comp("id2", "c2"), "id2", "left")
    ends = ends.where("(c1 is not null or c2 is not null) and not (c1 is not null and c2 is not null and c1 = c2)")
    member = lambda c, to: clusters.select(F.col("comp").alias(c), F.col("id").alias(to))
    wide = ends.join(member("c1", "m1"), "c1", "left").join(member("c2", "m2"), "c2", "left")
    a, b = F.coalesce("m1", "id1"), F.coalesce("m2", "id2")
    pairs = wide.select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")).where("id1 <> id2").distinct()
    return exclude_entities(exclude_pairs(exclude_pairs(pairs, negatives), positives), banned)


def transitive_pairs(clusters: DataFrame, positives: DataFrame, negatives: DataFrame, banned: DataFrame, max_positives: int = 0, max_negatives: int = 0, seed: str = "closure") -> DataFrame:
    """(id1, id2, target): positives first, then negatives that are no positive.

    ``max_positives`` and ``max_negatives`` keep a random sample of so many pairs of either kind
    (by hash, the same on any cluster); 0 keeps all.
    """
    key = random_key(seed, F.col("id1"), F.col("id2"))
    few = lambda df, n: hash_sample(df.withColumn("_key", key), "_key", n).drop("_key") if n else df
    pos = cut(few(transitive_positives(clusters, positives), max_positives), "positives")
    neg = few(transitive_negatives(clusters, positives, negatives, banned), max_negatives)
    return pos.withColumn("target", F.lit(1.0)).unionByName(exclude_pairs(neg, pos).withColumn("target", F.lit(0.0)))
