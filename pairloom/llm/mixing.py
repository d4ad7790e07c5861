"""Problem 9: mixing sources to target weights.

Token sizes are counted once with a public tokenizer.  Iterative proportional fitting rakes
the weights of (source, language, topic) cells to the marginals, under each source's limit
of repeats, and every document is drawn by its calibrated weight: the whole part is certain,
the rest a hash draw.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.splits import category_key
from pairloom.operators.sampling import portable_int
from pairloom.workspace import cut

#: Ranks of the public tokenizer; a parameter, the file stays outside the repository.
TOKENIZER = os.environ.get("PAIRLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before byte-pair merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Languages that count as their own; all else is one marginal class.
LANGUAGES = ("ru", "en", "de")
#: Raking ends once no weight moves by more than TOLERANCE; the caps can keep it moving forever, so after MAX_ROUNDS it ends too, and says so.
MAX_ROUNDS, TOLERANCE = 300, 1e-6


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``documents`` (doc_id, text, ...) with ``tokens`` in place of the text; null and empty texts have 0.

    The driver reads the tokenizer's file (a few MB at most) and sends it to the workers.
    """
    rest = [c for c in documents.columns if c != "text"]
    schema = documents.select(*rest).withColumn("tokens", F.lit(0).cast("bigint")).schema
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.splitlines() if line.strip())}
        encoder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sizes, pa.int64())], [*rest, "tokens"])

    return documents.select("text", *rest).mapInArrow(run, schema)


def source_key(c: str | Column) -> Column:
    """A source without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))


def sized(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, src, language, topic, tokens) of the documents with a source.

    The topic is the category of the document's card, or 'none'; wrong or missing languages
    are 'other'.
    """
    docs = documents.select("doc_id", "text", "item_id", source_key("source").alias("src"), F.lower(F.trim("lang")).alias("lang")).where("src is not null and src <> ''")
    counted = cut(token_counts(docs), "tokens")
    topics = items.where("id is not null and category is not null").groupBy(F.col("id").alias("item_id")).agg(F.min(category_key("category")).alias("topic"))
    spread = F.coalesce("item_id", -F.col("doc_id") - 1)  # documents without a card spread out
    joined = counted.withColumn("item_id", spread).join(topics, "item_id", "left")
    language = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    return joined.select("doc_id", "src", language.alias("language"), F.coalesce("topic", F.lit("none")).alias("topic"), "tokens")


def rake(cells: dict[tuple, float], marginals: list[dict[str, float]], caps: list[float]) -> tuple[dict[tuple, float], bool]:
    """Weights by cell such that weighted sizes match every marginal, as far as the caps allow, and whether they converged.

    ``cells`` are sizes by key (one part per marginal); ``marginals`` target sizes by part;
    ``caps`` the largest weight of each cell, in order.  Where caps bind, the first marginal
    comes first: what it lacks is added to its cells below their cap at the other marginals' expense.
    """
    keys = list(cells)
    weight = dict.fromkeys(keys, 1.0)
    cap = dict(zip(keys, caps, strict=True))
    converged = False
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for axis in range(len(marginals) - 1, -1, -1):  # the first marginal is fitted last
            sums: dict[str, float] = {}
            for k in keys:
                sums[k[axis]] = sums.get(k[axis], 0.0) + weight[k] * cells[k]
            for k in keys:
                want, have = marginals[axis].get(k[axis], 0.0), sums[k[axis]]
                factor = want / have if have else 0.0
                new = min(cap[k], weight[k] * factor)
                worst = max(worst, abs(new - weight[k]))
                weight[k] = new
        if converged := worst < TOLERANCE:
            break
    for part, want in marginals[0].items():  # a source held down by caps in some cells is topped up in the others
        own = [k for k in keys if k[0] == part]
        while True:  # every round but the last brings a cell to its cap
            lack = want - sum(weight[k] * cells[k] for k in own)
            room = [k for k in own if weight[k] < cap[k] - 1e-12]
            size = sum(weight[k] * cells[k] for k in room)
            if lack <= 1e-9 * max(want, 1.0) or not room:
                break
            for k in room:
                weight[k] = min(cap[k], weight[k] * (1 + lack / size) if size else cap[k])
    return weight, converged


class Mix:
    """A mix of ``documents``: ``plan`` (one row per target source), ``drawn`` (doc_id, src, tokens, repeats)."""

    def __init__(self, documents: DataFrame, items: DataFrame, targets: DataFrame, seed: str = "p9"):
        spark = documents.sparkSession
        self.docs = cut(sized(documents, items), "sized")
        table = self.docs.groupBy("src", "language", "topic").agg(F.sum("tokens").alias("n")).where("n > 0")
        goal = {r.k: r for r in targets.select("source", source_key("source").alias("k"), "target_share", "max_repeats").collect()}
        known = table.join(F.broadcast(targets.select(source_key("source").alias("src")).distinct()), "src", "left_semi")
        cells = {(r.src, r.language, r.topic): float(r.n) for r in known.collect()}  # given sources x languages x categories
        self.total = float(table.agg(F.sum("n")).head()[0] or 0)
        sizes: dict[str, float] = {}
        for k, n in cells.items():
            sizes[k[0]] = sizes.get(k[0], 0.0) + n
        # a mix as large as the corpus, each source at most at its limit; shares are kept by scaling nothing else down
        by_source = {s: min(r.target_share * self.total, r.max_repeats * sizes.get(s, 0.0)) for s, r in goal.items()}
        whole, corpus = sum(by_source.values()), sum(sizes.values()) or 1.0
        margins = [by_source]
        for axis in (1, 2):
            margin: dict[str, float] = {}
            for k, n in cells.items():
                margin[k[axis]] = margin.get(k[axis], 0.0) + n * whole / corpus
            margins.append(margin)
        self.weights, self.converged = rake(cells, margins, [float(goal[k[0]].max_repeats) for k in cells])
        self.goals = [(axis, part, want) for axis, margin in zip(("source", "language", "topic"), margins, strict=True) for part, want in sorted(margin.items())]
        reached: dict[str, float] = dict.fromkeys(goal, 0.0)
        for k, n in cells.items():
            reached[k[0]] += self.weights[k] * n
        # the fit gives a source its share unless all its cells are at their limit
        rows = [(r.source, s, float(r.target_share), int(r.max_repeats), int(sizes.get(s, 0)), r.target_share * self.total, reached[s] < r.target_share * self.total * (1 - 1e-7)) for s, r in sorted(goal.items())]
        self.plan = spark.createDataFrame(rows, "source string, src string, target_share double, max_repeats int, available bigint, wanted double, short boolean")
        weights = spark.createDataFrame([(*k, w) for k, w in self.weights.items()], "src string, language string, topic string, weight double")
        drawn = self.docs.join(F.broadcast(weights), ["src", "language", "topic"])
        draw = portable_int(F.concat_ws("|", F.lit(seed), "doc_id")) / F.lit(2.0**32)
        repeats = F.floor("weight") + F.when(draw < F.col("weight") - F.floor("weight"), 1).otherwise(0)
        self.cells = drawn.select("doc_id", "src", "language", "topic", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
        self.drawn = self.cells.select("doc_id", "src", "tokens", "repeats")

    def marginals(self) -> DataFrame:
        """(axis, part, wanted, drawn, converged): wanted and drawn tokens of every source, language and topic."""
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("part")) for a, c in (("source", "src"), ("language", "language"), ("topic", "topic"))]))
        got = self.cells.select(each.alias("m"), (F.col("tokens") * F.col("repeats")).alias("t")).groupBy("m.axis", "m.part").agg(F.sum("t").alias("drawn"))
        wanted = self.docs.sparkSession.createDataFrame(self.goals, "axis string, part string, wanted double")
        return wanted.join(got, ["axis", "part"], "left").select("axis", "part", F.round("wanted", 1).alias("wanted"), F.coalesce("drawn", F.lit(0)).alias("drawn"), F.lit(self.converged).alias("converged"))

    def shares(self) -> DataFrame:
        """The plan with the tokens drawn and the shares reached, of all drawn tokens."""
        got = self.drawn.groupBy("src").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("doc_id").alias("documents"))
        whole = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
        return self.plan.join(F.broadcast(whole)).join(got, "src", "left").select(
            "source", "target_share", "max_repeats", "available", "short", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
            F.coalesce(F.try_divide("drawn_tokens", "all_tokens"), F.lit(0.0)).alias("share"),
        )
