"""Pair scorers behind one interface, swap averaging, rank blending and failure isolation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import set_jaccard, words
from pairloom.operators.ranking import ordinal


class Scorer(Protocol):
    """Adds a double column to pairs that carry text1 and text2."""

    def score(self, pairs: DataFrame, name: str) -> DataFrame: ...


class LexicalScorer:
    """Word-set Jaccard of the two texts; built-in expressions only."""

    def score(self, pairs: DataFrame, name: str) -> DataFrame:
        staged = pairs.withColumn("_words1", words(F.col("text1"))).withColumn("_words2", words(F.col("text2")))
        return staged.withColumn(name, set_jaccard(F.col("_words1"), F.col("_words2"), 0.0)).drop("_words1", "_words2")


class ModelScorer:
    """A model loaded once per task and applied to Arrow batches, longest texts last within a partition."""

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
        self.load = load

    def score(self, pairs: DataFrame, name: str) -> DataFrame:
        load = self.load
        schema = pairs.withColumn(name, F.lit(0.0)).schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                yield batch.assign(**{name: model(batch["text1"].fillna("").tolist(), batch["text2"].fillna("").tolist())})

        ordered = pairs.sortWithinPartitions(F.length(F.coalesce("text1", F.lit(""))) + F.length(F.coalesce("text2", F.lit(""))))
        return ordered.mapInPandas(run, schema)


def swap_averaged(pairs: DataFrame, scorer: Scorer, name: str, keys: list[str]) -> DataFrame:
    """``pairs`` with the mean of a scorer's scores of both orders of the texts."""
    orders = F.array(F.struct(F.col("text1").alias("a"), F.col("text2").alias("b")), F.struct(F.col("text2").alias("a"), F.col("text1").alias("b")))
    both = pairs.select(*keys, F.explode(orders).alias("o")).select(*keys, F.col("o.a").alias("text1"), F.col("o.b").alias("text2"))
    return scorer.score(both, name).groupBy(*keys).agg(F.avg(name).alias(name))


def rank01(scored: DataFrame, score: str, order: list, name: str) -> DataFrame:
    """``scored`` with the position / n of ``score`` ascending, ties by ``order``; NaN and null take the top ranks."""
    n = scored.count()
    key = F.when(F.col(score).isNull(), F.lit(float("nan"))).otherwise(F.col(score))
    return ordinal(scored, [key.asc(), *order], "_at").withColumn(name, F.col("_at") / F.lit(float(max(n, 1)))).drop("_at")


def blend(ranked: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Weighted mean of rank columns."""
    whole = sum(weights.values())
    parts = [F.lit(w) * F.col(c) for c, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return ranked.withColumn(name, out / F.lit(whole))


def second_pass_fits(started: float, first_pass: float, limit: float, now: float | None = None) -> bool:
    """Whether a swapped pass as long as the first (and 5 % more) ends within 92 % of ``limit``."""
    return (now if now is not None else time.time()) - started + 1.05 * first_pass <= 0.92 * limit


def score_or_fallback(pairs: DataFrame, scorers: list[Scorer], name: str, materialise: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The first scorer whose job succeeds, lexical overlap if none does; and the failures."""
    failures = []
    for scorer in scorers:
        try:
            return materialise(scorer.score(pairs, name)), failures
        except Exception as e:  # a scorer is foreign code: any failure means the next one
            failures.append(f"{type(scorer).__name__}: {e}"[:300])
    return LexicalScorer().score(pairs, name), failures
