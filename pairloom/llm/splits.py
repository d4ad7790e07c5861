"""Problem 2: splits that keep related records together.

Persisted tables (SplitState) grow with every batch of rows: nodes with their component,
components with their split, and rows by component and category.  New rows are joined to the
components they touch, merges are resolved by pointer jumping over the touched components
only, components with one split keep it, components without one fill the deficits counted over
all batches, and merges of components with different splits are quarantined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.groups import components
from pairloom.workspace import cut

#: A component with more than this part of its category's rows is placed one by one.
LARGE_PART = 1 / 200
#: Small components of a category are placed in this many portions.
PORTIONS = 1024


@dataclass
class SplitState:
    """What is kept between batches.

    ``nodes`` (node, component), ``splits`` (component, split, torn): split is null for a
    quarantined component, and ``sizes`` (component, cat, n): rows of all batches.
    """

    nodes: DataFrame
    splits: DataFrame
    sizes: DataFrame

    def write(self, path: str) -> SplitState:
        """The state as three tables under ``path``, which must be another one than it was read from."""
        for name in ("nodes", "splits", "sizes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return SplitState.read(self.nodes.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> SplitState:
        return SplitState(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "splits", "sizes")))

    def quarantined(self) -> DataFrame:
        """(component, node): all members of components whose merger joined different splits, old ones included."""
        return self.nodes.join(self.splits.where("torn").select("component"), "component", "left_semi").select("component", "node")


def category_key(column: str | Column) -> Column:
    """A category without case, white space and punctuation."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{Nd}]+", "")


def row_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` (id1, id2, comp, ...) with ``nodes``: the component and cards that a row names, as text; nulls name nothing."""
    name = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    return rows.withColumn("nodes", F.array_compact(F.array(name("c", "comp"), name("i", "id1"), name("i", "id2"))))


def merged(rows: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """((node, component), (was, component)): all nodes after adding ``rows`` to ``known`` (node, component), and the components renamed.

    Only edges between the components that rows touch are resolved, not the known members; the
    second table is None without ``known``.
    """
    ends = rows.where(F.size("nodes") > 0).select(F.explode("nodes").alias("node"), F.element_at("nodes", 1).alias("first")).distinct()
    if known is None:
        pairs = ends.select(F.col("first").alias("a"), F.col("node").alias("b"))
        found = cut(components(pairs), "components")
        alone = ends.select("node").distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        return found.select("node", F.col("label").alias("component")).unionByName(alone), None
    at = lambda c, to: known.select(F.col("node").alias(c), F.col("component").alias(to))
    touched = ends.join(at("node", "b"), "node", "left").join(at("first", "a"), "first", "left")
    touched = cut(touched.select("node", F.col("b").isNull().alias("fresh"), F.coalesce("b", "node").alias("b"), F.coalesce("a", "first").alias("a")), "touched")
    roots = cut(components(touched.select("a", "b")).where("node <> label").select(F.col("node").alias("was"), F.col("label").alias("component")), "roots")
    fresh = touched.where("fresh").select("node", F.col("b").alias("was")).distinct()
    everyone = known.select("node", F.col("component").alias("was")).unionByName(fresh)
    return everyone.join(roots, "was", "left").select("node", F.coalesce("component", "was").alias("component")), roots


def conflicts(rows: DataFrame, split: str) -> DataFrame:
    """(component, node) of every component whose rows already lie in several values of ``split``: the quarantine.

    ``rows`` need id1, id2, comp and ``split``; a null split is none.
    """
    rows = cut(row_nodes(rows.select("id1", "id2", "comp", split)), "rows")
    table = cut(merged(rows)[0], "table")
    placed = rows.where(F.size("nodes") > 0).select(F.element_at("nodes", 1).alias("node"), split)
    torn = placed.join(table, "node").groupBy("component").agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").select("component")
    return table.join(torn, "component", "left_semi").select("component", "node")


def torn_comps(folds: DataFrame) -> DataFrame:
    """(comp): non-null comps whose related rows lie in more than one fold."""
    return conflicts(folds, "fold").where(F.col("node").startswith("c")).select(F.substring("node", 2, 30).cast("bigint").alias("comp")).distinct()


def _renamed(table: DataFrame, roots: DataFrame) -> DataFrame:
    """``table`` (component, ...) under the components' names after a merge."""
    return table.withColumnRenamed("component", "was").join(roots, "was", "left").withColumn("component", F.coalesce("component", "was")).drop("was")


def assign_splits(rows: DataFrame, targets: DataFrame, state: SplitState | None = None) -> tuple[DataFrame, SplitState]:
    """``rows`` with ``component`` and ``split``, in the shares of ``targets`` (split, target_share), also within each category, and the new state.

    Components of ``state`` keep their split; a component that joins several splits is quarantined: its
    split is null, of old and new rows.  Shares are those of the rows of all batches.  A
    component counts to the category of most of its rows.  Rows that name no node are components
    of their own.  Large components (LARGE_PART of a category, so a bounded number) are
    placed one by one where most is missing; the many small ones by portions of a hash, so no
    task sorts or collects them.  Columns of these names that rows already have are replaced.
    """
    names = [(r.split, float(r.target_share)) for r in targets.orderBy(F.desc("target_share"), "split").collect()]
    rows = rows.drop("component", "split", "nodes")
    rows = rows.withColumn("_row", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]))
    rows = cut(row_nodes(rows), "rows")
    table, roots = merged(rows, state.nodes if state else None)
    table = cut(table, "table")
    node = F.when(F.size("nodes") > 0, F.element_at("nodes", 1))
    placed = rows.withColumn("_node", node).join(table.withColumnRenamed("node", "_node"), "_node", "left")
    placed = cut(placed.withColumn("component", F.coalesce("component", F.concat(F.lit("r"), F.col("_row").cast("string")))).drop("_node", "_row", "nodes").withColumn("_cat", F.coalesce(category_key("category"), F.lit(""))), "placed")
    sizes = placed.groupBy("component", F.col("_cat").alias("cat")).agg(F.count(F.lit(1)).alias("n"))
    if state:
        sizes = sizes.unionByName(_renamed(state.sizes, roots)).groupBy("component", "cat").agg(F.sum("n").alias("n"))
    sizes = cut(sizes, "sizes")
    size = sizes.groupBy("component").agg(F.sum("n").alias("n"), F.max(F.struct("n", "cat")).alias("m")).select("component", "n", F.col("m.cat").alias("cat"))
    if state:
        old = _renamed(state.splits, roots).groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.max("torn").alias("was_torn"))
        torn = F.coalesce(F.col("was_torn") | (F.col("lo") != F.col("hi")), F.lit(False))
        size = size.join(old, "component", "left").select("component", "n", "cat", F.when(~torn, F.col("lo")).alias("kept"), torn.alias("torn"))
    else:
        size = size.withColumn("kept", F.lit(None).cast("string")).withColumn("torn", F.lit(False))
    size = cut(size, "components")
    totals = size.groupBy("cat").agg(F.sum("n").alias("total"))
    fresh = size.where("kept is null and not torn").join(totals, "cat")
    is_large = F.col("n") > F.greatest(F.col("total") * LARGE_PART, F.lit(1))
    done: dict[str, dict[str, float]] = {}
    for r in size.where("kept is not null").groupBy("cat", "kept").agg(F.sum("n").alias("n")).collect():  # one row per category and split
        done.setdefault(r.cat, {})[r.kept] = float(r.n)
    sums = {r.cat: r.total for r in totals.collect()}  # one row per category key
    large: list[tuple[str, str]] = []
    for r in fresh.where(is_large).orderBy(F.desc("n"), "component").collect():  # at most 1/LARGE_PART per category
        have = done.setdefault(r.cat, {})
        best = max(names, key=lambda t: (t[1] * sums[r.cat] - have.get(t[0], 0.0), t[1]))[0]
        have[best] = have.get(best, 0.0) + r.n
        large.append((r.component, best))
    spark = rows.sparkSession
    bounds = []
    for cat, total in sums.items():
        lack = [max(0.0, share * total - done.get(cat, {}).get(name, 0.0)) for name, share in names]
        whole, upto, row = sum(lack) or 1.0, 0.0, []
        for x in lack:
            upto += x / whole
            row.append(upto)
        bounds.append((cat, row))
    small = fresh.where(~is_large).withColumn("portion", F.pmod(F.xxhash64("component"), F.lit(PORTIONS)))
    portions = small.groupBy("cat", "portion").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("cat").orderBy("portion").rowsBetween(Window.unboundedPreceding, 0)
    at = portions.withColumn("at", (F.sum("n").over(w) - F.col("n") / 2) / F.sum("n").over(Window.partitionBy("cat")))
    at = at.join(spark.createDataFrame(bounds, "cat string, bounds array<double>"), "cat")
    pick = F.coalesce(*[F.when(F.col("at") <= F.col("bounds")[i] + 1e-9, F.lit(name)) for i, (name, _) in enumerate(names)], F.lit(names[0][0] if names else None))
    chosen = small.join(at.select("cat", "portion", pick.alias("split")), ["cat", "portion"]).select("component", "split")
    big = spark.createDataFrame(large, "component string, split string")
    kept = size.where("kept is not null").select("component", F.col("kept").alias("split"))
    new = chosen.unionByName(big).unionByName(kept).withColumn("torn", F.lit(False)).unionByName(size.where("torn").select("component", F.lit(None).cast("string").alias("split"), "torn"))
    new = cut(new, "splits")
    return placed.join(new.select("component", "split"), "component", "left").drop("_cat"), SplitState(table, new, sizes)


def assign_batches(batches: list[DataFrame], targets: DataFrame) -> tuple[DataFrame, SplitState | None]:
    """All rows of ``batches``, assigned one after the other, with the component and split that they have in the end."""
    state, done = None, []
    for rows in batches:
        assigned, state = assign_splits(rows, targets, state)
        done.append(assigned.drop("split"))
    if state is None:
        raise ValueError("no batches")
    now = done[0]
    for part in done[1:]:
        now = now.unionByName(part)
    # a row's component may have been merged since: its first node, or its own name, tells
    node = F.coalesce(F.concat(F.lit("c"), F.col("comp").cast("string")), F.concat(F.lit("i"), F.col("id1").cast("string")), F.concat(F.lit("i"), F.col("id2").cast("string")))
    final = now.withColumn("_node", node).join(state.nodes.withColumnRenamed("component", "_now").withColumnRenamed("node", "_node"), "_node", "left")
    final = final.withColumn("component", F.coalesce("_now", "component")).drop("_node", "_now")
    return final.join(state.splits.select("component", "split"), "component", "left"), state
