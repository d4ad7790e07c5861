"""Problem 8: evaluation texts leaking into training text.

Latent semantic retrieval.  The evaluation passages are cut into overlapping segments, weighted by
TF-IDF, and a randomised SVD (range finder with power iterations, its products summed over
partitions) gives a latent space.  Windows of every document are projected into it; segments
within a cosine bound are candidates, which are then checked for a run of consecutive common
words.  What the bound of a truncated space could miss is met exactly: by the digest of every run.
Paraphrases may replace any word, so their candidates are all passages of which a
document has enough words in whatever order; the longest common subsequence decides, and
then a check of the answer: the words that no other passage has.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
RUN_WORDS = 8
#: Segments of passages and windows of documents; any run of RUN_WORDS lies whole in one of each.
SEGMENT, SEGMENT_STEP = 16, 8
WINDOW, WINDOW_STEP = 12, 4
#: Hashed dimensions, latent dimensions, and further ones while searching the range.
DIMS, RANK, EXTRA = 1 << 13, 192, 16
POWER_STEPS = 2
#: Candidates of the latent search are segments at least this similar to a window; how many leaks it proposes by itself is reported.
MIN_COSINE = 0.3
#: Passages are handled in blocks of this many, each block in one pass over the documents.
BLOCK = 2_000
#: A paraphrase shares this part of the passage's words, in order, within one document.
PARAPHRASE = 0.6
#: and this part of the words that tell the passage from all others.
ANSWER = 0.5

# Invisible characters, which may stand inside words.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, after removing invisible characters."""
    return _WORD.findall(_INVISIBLE.sub("", text).lower()) if text else []


def _spans(n: int, size: int, step: int) -> Iterator[tuple[int, int]]:
    start = 0
    while True:
        yield start, min(n, start + size)
        if start + size >= n:
            return
        start += step


def _slot(word: str) -> int:
    h = 2166136261
    for b in word.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % DIMS


def _vector(words: list[str], idf: dict[str, float], slots: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the words that have an idf, of norm 1."""
    counts = Counter(w for w in words if w in idf)
    at = np.fromiter((slots[w] for w in counts), np.int64, len(counts))
    weight = np.fromiter(((1 + math.log(n)) * idf[w] for w, n in counts.items()), np.float64, len(counts))
    norm = np.sqrt((weight**2).sum())
    return at, weight / norm if norm else weight


def _dense(segments: list[list[str]], idf: dict[str, float], slots: dict[str, int]) -> np.ndarray:
    rows = np.zeros((len(segments), DIMS), np.float32)
    for i, s in enumerate(segments):
        at, weight = _vector(s, idf, slots)
        np.add.at(rows[i], at, weight)
    return rows


def latent_basis(segments: DataFrame, idf: dict[str, float], slots: dict[str, int], rank: int = RANK) -> np.ndarray:
    """DIMS x rank basis of the rows' leading right singular vectors, by distributed randomised SVD.

    Every round multiplies the current basis by A'A: partitions return their sums of
    DIMS x (rank + EXTRA), which do not grow with the rows.
    """
    width = rank + EXTRA
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((DIMS, width)))[0].astype(np.float32)
    for _ in range(POWER_STEPS + 1):

        def run(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> Iterator[pa.RecordBatch]:
            total = np.zeros((DIMS, width), np.float64)
            for batch in batches:
                rows = _dense(batch.column("words").to_pylist(), idf, slots)
                total += rows.T @ (rows @ basis)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part"])

        parts = segments.mapInArrow(run, "part binary").toLocalIterator()
        total = sum((np.frombuffer(p.part, np.float32).reshape(DIMS, width).astype(np.float64) for p in parts), np.zeros((DIMS, width)))
        basis = np.linalg.qr(total)[0].astype(np.float32)
    return basis[:, :rank]


FOUND = "doc_id bigint, item_id bigint, verbatim boolean, latent boolean, share double"


class PassageIndex:
    """A block of passages: vocabulary, latent segments, and words for the exact check."""

    def __init__(self, rows: list[tuple[int, list[str]]], spark):
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        self.owner: list[int] = []
        segments: list[list[str]] = []
        for p, words in enumerate(self.words):
            for a, b in _spans(len(words), SEGMENT, SEGMENT_STEP):
                if b - a >= RUN_WORDS:
                    segments.append(words[a:b])
                    self.owner.append(p)
        df = Counter(w for s in segments for w in set(s))
        self.idf = {w: 1 + math.log(len(segments) / n) for w, n in df.items()}
        self.slots = {w: _slot(w) for w in self.idf}
        self.owner_at = np.array(self.owner, np.int64)
        if segments:
            table = spark.createDataFrame([(s,) for s in segments], "words array<string>").repartition(4)
            self.basis = latent_basis(table, self.idf, self.slots)
            latent = _dense(segments, self.idf, self.slots) @ self.basis
            self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)
        # passages too short to leak are no case of a paraphrase either
        self.sizes = np.array([len(w) if len(w) >= RUN_WORDS else np.inf for w in self.words])
        held: dict[str, list[tuple[int, int]]] = {}
        for p, words in enumerate(self.words):
            for w, n in Counter(words).items():
                held.setdefault(w, []).append((p, n))
        self.held = {w: np.array(ps, np.int64) for w, ps in held.items()}
        self.grams = [{tuple(w[i : i + RUN_WORDS]) for i in range(len(w) - RUN_WORDS + 1)} for w in self.words]
        self.runs: dict[tuple, list[int]] = {}
        for p, grams in enumerate(self.grams):
            for g in grams:
                self.runs.setdefault(g, []).append(p)
        self.answers = [{w for w in set(words) if len(held[w]) == 1} for words in self.words]

    def _stretches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of at least RUN_WORDS words of the passages' vocabulary; no run of a passage lies outside them."""
        start = None
        for i in range(len(words) + 1):
            if i < len(words) and words[i] in self.idf:
                start = i if start is None else start
            elif start is not None:
                if i - start >= RUN_WORDS:
                    yield start, i
                start = None

    def candidates(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Spans of ``words`` by the passage whose segments they resemble."""
        spans = [(start + a, start + b) for start, end in self._stretches(words) for a, b in _spans(end - start, WINDOW, WINDOW_STEP)]
        found: dict[int, list[tuple[int, int]]] = {}
        if not spans or not self.owner:
            return found
        projected = np.zeros((len(spans), self.basis.shape[1]), np.float32)
        for k, (a, b) in enumerate(spans):
            at, weight = _vector(words[a:b], self.idf, self.slots)
            projected[k] = weight.astype(np.float32) @ self.basis[at]
        projected /= np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)
        for chunk in range(0, len(spans), 256):
            near = projected[chunk : chunk + 256] @ self.latent >= MIN_COSINE
            for k, s in zip(*np.nonzero(near), strict=True):
                found.setdefault(int(self.owner_at[s]), []).append(spans[chunk + k])
        return found

    def leaks(self, words: list[str]) -> dict[int, bool]:
        """Positions of the passages of which ``words`` hold RUN_WORDS consecutive words, and whether the latent search proposed them."""
        out: dict[int, bool] = {}
        for p, spans in self.candidates(words).items():
            grams = self.grams[p]
            if any(tuple(words[i : i + RUN_WORDS]) in grams for a, b in set(spans) for i in range(a, b - RUN_WORDS + 1)):
                out[p] = True
        for start, end in self._stretches(words):
            for i in range(start, end - RUN_WORDS + 1):
                for p in self.runs.get(tuple(words[i : i + RUN_WORDS]), ()):
                    out.setdefault(p, False)
        return out

    def paraphrases(self, words: list[str]) -> list[tuple[int, float]]:
        """Positions of the passages of which ``words`` keep PARAPHRASE in order, and the part kept.

        The words in common, in any order, bound the longest common subsequence from above, so
        no paraphrase is lost.  Of a passage's own words, those of no other passage of the block,
        ANSWER must be there too: templates that many passages share are no leak.
        """
        counts = {w: n for w, n in Counter(words).items() if w in self.held}
        if not counts:
            return []
        held = [self.held[w] for w in counts]
        at, n = np.concatenate(held).T
        common = np.bincount(at, np.minimum(n, np.repeat(list(counts.values()), [len(h) for h in held])), len(self.words))
        shares = ((int(p), _lcs(self.words[p], words) / len(self.words[p])) for p in np.flatnonzero(common / self.sizes >= PARAPHRASE))
        told = lambda p: len(self.answers[p] & counts.keys()) >= ANSWER * len(self.answers[p])
        return [(p, share) for p, share in shares if share >= PARAPHRASE and told(p)]


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a bit for each word of ``a``, one step for each of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        if y in places:
            hit = free & places[y]
            free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def _indexes(passages: DataFrame) -> Iterator[PassageIndex]:
    """One index for each block of passages, in the order of their ids.

    The evaluation set is a stated query set; a block bounds what a pass sends to the workers.
    """
    spark = passages.sparkSession
    rows = passages.where("item_id is not null and text is not null").orderBy("item_id")
    block: list[tuple[int, list[str]]] = []
    for row in rows.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, words_of(row.text)))
        if len(block) == BLOCK:
            yield PassageIndex(block, spark)
            block = []
    if block:
        yield PassageIndex(block, spark)


def _search(documents: DataFrame, index: PassageIndex, paraphrases: bool) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))  # bounded by BLOCK passages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent.value)
        for batch in batches:
            docs, items, runs, latent, shares = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                exact = index.leaks(words)
                for p, proposed in sorted(exact.items()):
                    docs.append(doc), items.append(index.ids[p]), runs.append(True), latent.append(proposed), shares.append(1.0)
                if paraphrases:
                    for p, share in index.paraphrases(words):
                        if p not in exact:
                            docs.append(doc), items.append(index.ids[p]), runs.append(False), latent.append(False), shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(runs, pa.bool_()), pa.array(latent, pa.bool_()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "verbatim", "latent", "share"])

    return documents.select("doc_id", "text").mapInArrow(run, FOUND)


def leaks(documents: DataFrame, passages: DataFrame, paraphrases: bool = False) -> DataFrame:
    """(doc_id, item_id, verbatim, latent, share): documents and the passages they hold.

    ``verbatim`` rows hold RUN_WORDS consecutive words of the passage; ``latent`` ones were proposed by
    the latent search, the rest met by the digest of a run.  With ``paraphrases``
    documents also count that keep PARAPHRASE of the passage's words in order.  Null and
    empty texts hold nothing; passages of fewer than RUN_WORDS words can't leak.
    """
    out = None
    for index in _indexes(passages):
        part = _search(documents, index, paraphrases)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], FOUND)
    return out.distinct()


def leak_report(found: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, task, documents, verbatim): per passage how many documents hold it."""
    counts = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_if("verbatim").alias("verbatim"))
    return passages.select("item_id", "task").join(counts, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("verbatim", F.lit(0)).alias("verbatim"))
