"""Assembling training pools: purges with reasons, caps, holdouts, weights, a linear model and its probe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import scores as S
from pairloom.functions import text as T
from pairloom.operators import pairs as P
from pairloom.operators.metrics import average_precision, macro_average_precision
from pairloom.operators.ranking import exact_quantiles
from pairloom.operators.sampling import hash_sample, random_key, smallest_per_group
from pairloom.sources.tables import scan
from pairloom.workspace import cut

def purge_flags(pairs: DataFrame, banned_pairs: DataFrame, ids: DataFrame, fps: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``pairs`` with by_pair, by_id and by_fp: the reasons to leave a pair out.

    Banned cards are first gathered into one table (id, by_id, by_fp), so either end of a pair
    is looked up once.
    """
    by_fp = fingerprints.join(fps, "fp", "left_semi").select("id", F.lit(True).alias("f"))
    cards = cut(ids.select("id", F.lit(True).alias("i")).join(by_fp, "id", "full").select("id", F.coalesce("i", F.lit(False)).alias("i"), F.coalesce("f", F.lit(False)).alias("f")), "banned")
    keys = P.pair_keys(banned_pairs).withColumn("_hit", F.lit(True))
    marked = P.attach(P.canonical(pairs, "lo", "hi"), cards, "i", "f").join(keys, ["lo", "hi"], "left")
    either = lambda c: F.coalesce(f"{c}1", F.lit(False)) | F.coalesce(f"{c}2", F.lit(False))
    return marked.select(*pairs.columns, F.coalesce("_hit", F.lit(False)).alias("by_pair"), either("i").alias("by_id"), either("f").alias("by_fp"))


def leakage_reasons(pairs: DataFrame, banned_pairs: DataFrame, ids: DataFrame, fps: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(id1, id2, reason): pairs that leak, with all reasons in order, repeats of content (keep the first) included."""
    flagged = purge_flags(pairs, banned_pairs, ids, fps, fingerprints)
    both = P.attach(flagged, fingerprints, "fp")
    w = Window.partitionBy(F.least("fp1", "fp2"), F.greatest("fp1", "fp2")).orderBy("id1", "id2")
    known = F.col("fp1").isNotNull() & F.col("fp2").isNotNull()
    # pairs without both fingerprints keep apart: one key each instead of one null key for all
    repeated = both.where(known).withColumn("twice", F.row_number().over(w) > 1).unionByName(both.where(~known).withColumn("twice", F.lit(False)))
    names = {"by_pair": "excluded_exact_pair", "by_id": "excluded_item_id", "by_fp": "excluded_item_fingerprint", "twice": "duplicate_content_pair"}
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in names.items()]))
    return repeated.select("id1", "id2", F.array_join(reasons, ";").alias("reason")).where("reason <> ''")


def capped(rows: DataFrame, positive: str, key: str, limit: int, pos_share: float) -> DataFrame:
    """At most ``limit`` rows, ``pos_share`` of them positive as far as there are; spare room goes to the rest."""
    count = {r[0]: r[1] for r in rows.groupBy(positive).count().collect()}  # two rows
    n_pos, n_neg = count.get(True, 0), count.get(False, 0)
    if n_pos + n_neg <= limit:
        return rows
    want_pos = min(n_pos, round(limit * pos_share))
    want_neg = min(n_neg, limit - want_pos)
    want_pos = min(n_pos, limit - want_neg)
    quota = F.when(F.col(positive), want_pos).otherwise(want_neg).cast("bigint")
    return smallest_per_group(rows.withColumn("_quota", quota), [positive], key, "_quota").drop("_quota")


def holdout(rows: DataFrame, target: int, pos_share: float = 0.1) -> DataFrame:
    """Confident pairs (category, label, key) with at most ``pos_share`` positives per category, then a proportional sample of about ``target``."""
    counts = rows.groupBy("category").agg(F.count_if(F.expr("label = 0")).alias("_neg"))
    most = F.floor(F.col("_neg") * F.lit(pos_share) / F.lit(1 - pos_share) + 1e-9)
    quota = F.when(F.col("label") == 1, most).otherwise(F.col("_neg")).cast("bigint")
    thinned = cut(smallest_per_group(rows.join(counts, "category").withColumn("_quota", quota), ["category", "label"], "key", "_quota").drop("_neg", "_quota"), "thinned")
    n = thinned.count()
    if n <= target:
        return thinned
    sizes = thinned.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).withColumn("_quota", F.floor(F.col("_n") * target / n).cast("bigint"))
    return smallest_per_group(thinned.join(sizes, "category"), ["category"], "key", "_quota").drop("_n", "_quota")


def variance_weights(rows: DataFrame, name: str, target: str = "target") -> DataFrame:
    """``rows`` with inverse-variance weights, divided by their median and clipped to 0.4..2."""
    raw = rows.withColumn("_w", S.inverse_variance(F.col(target)))
    (middle,) = exact_quantiles(raw, F.col("_w"), [0.5])
    return raw.withColumn(name, S.clip(F.col("_w") / F.lit(middle).cast("double"), 0.4, 2.0)).drop("_w")


def banned_cards(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id), (id): cards of the holdout and all with content of holdout or fold-0 cards; and the cards of fold 0."""
    fp = T.fingerprint(F.col("name"), F.col("attributes"), F.col("category")).alias("fp")
    held = cut(P.endpoints(scan(s, d, "hardval_v1", "id1", "id2")), "held")
    first = cut(P.endpoints(scan(s, d, "folds_v1").where("fold = 0").select("id1", "id2")), "first")
    cards = cut(P.first_cards(scan(s, d, "items", "id", "name", "attributes", "category", "loaded_at").select("id", fp, "loaded_at")), "fps")
    shown = scan(s, d, "hardval_v1_items").join(held, "id", "left_semi").select(fp)
    fps = shown.unionByName(cards.join(first, "id", "left_semi").select("fp")).distinct()
    return cut(held.unionByName(cards.join(fps, "fp", "left_semi").select("id")).distinct(), "banned"), first


def training_pool(s: SparkSession, d: str, min_confidence: float = 0.2, extra_limit: int = 0, extra_pos: float = 0.35, human_weight: float = 1.5, human_limit: int = 0) -> DataFrame:
    """(id1, id2, target, weight, stream): weak base, transitive extras that override it, and human pairs, none touching a card of the holdout or content of holdout or fold-0 cards.

    Human pairs also touch no card of fold 0 itself; a null fold is not fold 0.  ``extra_limit``
    caps the extras, ``extra_pos`` of them positive, ``human_limit`` the human pairs by a random sample;
    0 keeps all.
    """
    held, first = banned_cards(s, d)
    base = P.exclude_entities(P.weak_pairs(scan(s, d, "matches_llm", "id1", "id2", "target")), held).where(S.confidence(F.col("target")) >= min_confidence)
    base = base.select("id1", "id2", "target", S.base_weight(F.col("target")).alias("weight"))
    one = lambda df, c: df.where(f"id1 <> id2 and {c} is not null").groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.max(c).cast("double").alias("target"))
    extra = P.exclude_entities(one(scan(s, d, "transitive_pairs"), "target"), held).withColumn("key", random_key("extra", F.col("id1"), F.col("id2"))).withColumn("positive", F.col("target") >= 0.5)
    extra = capped(cut(extra, "extra"), "positive", "key", extra_limit, extra_pos) if extra_limit else extra
    extra = cut(extra.select("id1", "id2", "target", F.lit(1.0).alias("weight")), "extra")
    people = P.exclude_entities(P.exclude_entities(one(scan(s, d, "folds_v1").where("fold is null or fold <> 0"), "target"), held), first).withColumn("weight", F.lit(human_weight))
    if human_limit:
        people = hash_sample(people.withColumn("key", random_key("human", F.col("id1"), F.col("id2"))), "key", human_limit).drop("key")
    tagged = lambda df, name: df.withColumn("stream", F.lit(name))
    return tagged(P.exclude_pairs(base, extra), "base").unionByName(tagged(extra, "extra")).unionByName(tagged(people, "human"))


def rank_loss(scored: DataFrame, group: str, score: str, label: str, digits: int | None = None) -> DataFrame:
    """(group, pairs, loss): mean softplus of negative minus positive score over all positive-negative pairs of a group.

    Scores are first aggregated, so the join is over distinct scores, not rows.  ``digits``
    rounds scores first, which bounds the join for scores of full precision (three digits:
    a million pairs a group, an error of the loss below 0.001).
    """
    scored = scored if digits is None else scored.withColumn(score, F.round(score, digits))
    n = scored.groupBy(group, score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    pos = n.where("p > 0").select(group, F.col(score).alias("sp"), "p")
    neg = n.where("q > 0").select(group, F.col(score).alias("sn"), "q")
    joined = pos.join(neg, group)
    term = F.log1p(F.exp(F.col("sn") - F.col("sp"))) * F.col("p") * F.col("q")
    return joined.groupBy(group).agg(F.sum(F.col("p") * F.col("q")).cast("bigint").alias("pairs"), F.round(F.sum(term) / F.sum(F.col("p") * F.col("q")), 6).alias("loss"))


def _halves(rows: DataFrame, features: list[str], weight: str | None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    w = F.col(weight) if weight else F.lit(1.0)
    halves = F.array(F.struct(F.lit(1.0).alias("label"), (w * F.col("target")).alias("w")), F.struct(F.lit(0.0).alias("label"), (w * (1 - F.col("target"))).alias("w")))
    each = rows.select(*features, F.explode(halves).alias("h")).select(*features, "h.label", "h.w").where("w > 0")
    return VectorAssembler(inputCols=features, outputCol="features").transform(each)


def soft_label_model(rows: DataFrame, features: list[str], weight: str | None = None) -> DataFrame:
    """(name, value): logistic regression on soft targets, each row as a weighted positive and negative."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(weightCol="w", maxIter=50).fit(_halves(rows, features, weight))
    values = [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients), strict=True)]
    return rows.sparkSession.createDataFrame(values, "name string, value double")


def best_by_probe(rows: DataFrame, features: list[str], probe: DataFrame, group: str, label: str, steps: list[int], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The model (name, value) with the best macro average precision on ``probe`` after one of ``steps`` iterations, and all probes (step, macro_ap).

    Groups of ``probe`` without a positive don't count; the earlier of equally good models is kept.
    """
    from pyspark.ml.classification import LogisticRegression

    train = _halves(rows, features, weight).select("features", "label", "w").cache()
    found, best = [], None
    for step in sorted(steps):
        model = LogisticRegression(weightCol="w", maxIter=step).fit(train)
        margin = reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col(f) for f, c in zip(features, model.coefficients, strict=True)], F.lit(float(model.intercept)))
        ap = macro_average_precision(average_precision(probe.withColumn("_score", margin), group, "_score", label), "training").head().macro_ap or 0.0
        found.append((step, float(ap)))
        if best is None or ap > best[0]:
            best = (ap, [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients), strict=True)])
    train.unpersist()
    spark = rows.sparkSession
    return spark.createDataFrame(best[1] if best else [], "name string, value double"), spark.createDataFrame(found, "step int, macro_ap double")
