"""Problem 6: the same or nearly the same records across splits.

Every record is normalised (words of the name in sorted order, attributes as key=value) and
cut into content-defined chunks: a rolling hash over the last WINDOW characters decides where
a chunk ends, so a changed, inserted or dropped word changes only the chunks around it.
Brand, line and article code, as read from the card, are chunks too.  Chunk digests
are joined across the splits by the rarest ones of every record, shared chunk lengths are summed
into overlap fractions of either record, and candidate pairs pass an exact check of the facts
that both state.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.cards import _TOKEN, read_cards
from pairloom.llm.notation import fold
from pairloom.workspace import cut, release

#: Shared part, of the longer record, from which two records count as nearly the same.
NEAR = 0.6
#: The same with the article code, or brand and line, in common.
NEAR_NAMED = 0.3
#: Characters that the rolling hash looks at, and its average number of characters between cuts.
WINDOW, AVERAGE = 5, 10
#: Weight of an article code and of a brand or line among the names; cards named alike share names of ALIKE.
CODE_WEIGHT, WORD_WEIGHT, ALIKE = 2, 1, 2

_BASE = np.uint32(0x9E3779B1)
CHUNK_SCHEMA = "side int, chunks array<bigint>, sizes array<int>"


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def chunks(fields: list[str]) -> list[list[str]]:
    """Content-defined chunks of each of ``fields``.

    A chunk ends with its field and wherever the rolling hash of the last WINDOW characters of the
    field has the remainder 0; the hashes of all fields are rolled along one array.
    """
    sizes = np.fromiter(map(len, fields), np.int64, len(fields))
    codes = np.frombuffer("".join(fields).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return [[] for _ in fields]
    rolled = np.zeros(len(codes), np.uint32)
    for k in range(WINDOW if len(codes) >= WINDOW else 0):  # the polynomial of the window, one character at a time
        rolled *= _BASE
        rolled[WINDOW - 1 :] += codes[k : len(codes) - WINDOW + 1 + k]
    rolled ^= rolled >> np.uint32(15)
    ends = np.cumsum(sizes)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    cuts = np.flatnonzero((rolled % np.uint32(AVERAGE) == 0) & (inside >= WINDOW - 1)) + 1
    out, at = [], 0
    for text, end, size in zip(fields, ends.tolist(), sizes.tolist(), strict=True):
        begin, last, parts = end - size, 0, []
        while at < len(cuts) and cuts[at] <= end:
            place = int(cuts[at]) - begin
            parts.append(text[last:place])
            last = place
            at += 1
        if last < size:
            parts.append(text[last:])
        out.append(parts)
    return out


def record_fields(name: str | None, attributes: str | None) -> list[str]:
    """The normalised record: the words of the name in order, and every attribute as key=value.

    Attributes that are no JSON object are words of a text.  Repeated words and fields count once.
    """
    fields = [" ".join(sorted(set(_TOKEN.findall((name or "").lower().replace("ё", "е")))))]
    try:
        parsed = json.loads(attributes) if attributes else {}
    except ValueError:
        parsed = attributes
    if isinstance(parsed, dict):
        for key, value in parsed.items():
            text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
            fields.append(f"{fold(key)}={fold(text)}".replace("ё", "е"))
    elif isinstance(parsed, str):
        fields.append(" ".join(_TOKEN.findall(parsed.lower().replace("ё", "е"))))
    return list(dict.fromkeys(f for f in fields if f))


def _record_chunks(names: list, texts: list) -> dict[str, pa.Array]:
    """Columns of CHUNK_SCHEMA: digests and lengths of the distinct chunks of every record."""
    records = [record_fields(n, a) for n, a in zip(names, texts, strict=True)]
    parts = iter(chunks([f for fields in records for f in fields]))
    digests, sizes = [], []
    for fields in records:
        found = {_digest(c): len(c) for _ in fields for c in next(parts)}
        digests.append(list(found))
        sizes.append(list(found.values()))
    return {"chunks": pa.array(digests, pa.list_(pa.int64())), "sizes": pa.array(sizes, pa.list_(pa.int32()))}


def chunked(cards: DataFrame) -> DataFrame:
    """``cards`` (side, id, name, attributes) as rows of chunks with their lengths, names and facts.

    ``names`` are the digests of brand and line words and of the code, odd for the code; they are chunks as well.
    """
    source = read_cards(cards.withColumn("category", F.lit(None).cast("string")), _record_chunks, CHUNK_SCHEMA)
    even = lambda x: F.shiftleft(F.xxhash64(x), 1)
    names = F.concat(F.transform("ident", even), F.transform(F.array_compact(F.array(F.concat(F.lit("c"), F.col("code")))), lambda x: even(x) + 1))
    size = lambda t: F.transform(t, lambda x: F.length(x))
    rows = source.df.select(
        "side", "id", F.concat("chunks", names).alias("chunks"), F.concat("sizes", size("ident"), size(F.array_compact(F.array("code")))).alias("sizes"), names.alias("names"), "ident", _facts().alias("facts"),
    )
    done = cut(rows, "chunks")
    source.drop()
    release(cards.sparkSession)
    return done


def pair_ids(pairs: DataFrame) -> DataFrame:
    """(id): the distinct ids of either column of ``pairs``."""
    return pairs.select(F.explode(F.array("id1", "id2")).alias("id")).where("id is not null").distinct()


def cards_of(ids: DataFrame, *sources: DataFrame) -> DataFrame:
    """(id, name, attributes): one card for each of ``ids``, from the first of ``sources`` that has it."""
    found = None
    for rank, source in enumerate(sources):
        part = source.select("id", "name", "attributes").join(ids, "id", "left_semi").withColumn("rank", F.lit(rank))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min(F.struct("rank", "name", "attributes")).alias("c"))
    return best.select("id", "c.name", "c.attributes")


def _facts() -> Column:
    """The facts of a card as small hashes, to part cards that disagree before they are joined in full."""
    same = lambda *c: F.when(F.col(c[0]).isNotNull(), F.xxhash64(*c))
    return F.struct(same("code").alias("code"), same("colour").alias("colour"), same("pack").alias("pack"), same("dim").alias("dim"), same("dim", "amount").alias("amount"))


def _calm(a: str, b: str) -> Column:
    """Whether two cards' hashed facts do not disagree."""
    clash = lambda c: F.coalesce(F.col(f"{a}.{c}") != F.col(f"{b}.{c}"), F.lit(False))
    return ~(clash("code") | clash("colour") | clash("pack") | (clash("amount") & ~clash("dim")))


def _heavy(names: Column) -> Column:
    return F.aggregate(names, F.lit(0), lambda s, t: s + F.when(t % 2 != 0, CODE_WEIGHT).otherwise(WORD_WEIGHT))


def _prefixes(side: DataFrame, rarity: DataFrame) -> DataFrame:
    """(id, total, facts, chunk, before, ident, named): the chunks by which a record can be met, rarest first.

    Two records that share NEAR of the length of both share a chunk among the rarest up to more
    than 1 - NEAR of the length of either (``named`` false); two that share names of ALIKE share
    one among the rarest names up to all but less than ALIKE (``named`` true).  ``before`` is the
    length of the rarer chunks; where ``named``, it and ``ident`` are not needed and null.
    """
    each = side.select("id", F.explode(F.arrays_zip("chunks", "sizes")).alias("z"), "names").select("id", F.col("z.chunks").alias("chunk"), F.col("z.sizes").alias("size"), F.array_contains("names", F.col("z.chunks")).alias("name"))
    ranked = each.join(rarity, "chunk", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "chunk", "size", "name"))).alias("r"), F.sum("size").alias("total"))
    ranked = ranked.join(side.select("id", "facts", "ident"), "id")
    names = F.transform(F.filter("r", lambda x: x["name"]), lambda x: x.chunk)
    before = F.transform("r", lambda x, i: F.struct(x.df.alias("df"), x.chunk.alias("chunk"), F.aggregate(F.slice("r", 1, i), F.lit(0), lambda s, y: s + y["size"]).alias("before")))
    rare = ranked.select("id", "total", "facts", "ident", F.explode(before).alias("p")).where("p.df > 1").where(F.col("p.before") <= (1 - NEAR) * F.col("total"))
    named = ranked.withColumn("n", names).select("id", "total", "facts", "n", F.posexplode("n").alias("pos", "chunk")).where(_heavy(F.slice("n", F.col("pos") + 1, F.size("n"))) >= ALIKE)
    rare = rare.select("id", "total", "facts", "p.chunk", "p.before", "ident", F.lit(False).alias("named"))
    none = [F.lit(None).cast(t).alias(c) for c, t in rare.dtypes if c in ("before", "ident")]
    return rare.unionByName(named.select("id", "total", "facts", "chunk", *none, F.lit(True).alias("named")))


def _kin(a: str, b: str) -> Column:
    """Whether two cards have nearly the same brand or line word, or one has none at all."""
    near_word = lambda w, ws: F.exists(ws, lambda v: F.levenshtein(v, w, 2) >= F.when((F.length(w) > 3) | (v == w), 0).otherwise(3))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.exists(a, lambda w: near_word(w, F.col(b)))


def candidates(left: DataFrame, right: DataFrame, rarity: DataFrame) -> DataFrame:
    """(id1, id2), distinct: rows of ``left`` and ``right`` (see chunked) that may be nearly the same.

    What decides without all chunks decides here, so that few pairs are joined with them: the
    facts, the lengths, the words of brand and line, and that all that two records share follows the first
    chunk they share, in the order of rarity.  Pairs that are alike by name meet by their names as well.
    """
    p1, p2 = (_prefixes(x, rarity).select("chunk", "named", *[F.col(c).alias(f"{c}{n}") for c in ("id", "total", "before", "ident", "facts")]) for n, x in ((1, left), (2, right)))
    longer = F.greatest("total1", "total2")
    fits = F.when(F.col("named"), F.least("total1", "total2") >= NEAR_NAMED * longer).otherwise(F.least(F.col("total1") - F.col("before1"), F.col("total2") - F.col("before2")) >= NEAR * longer)
    met = p1.join(p2, ["chunk", "named"]).where(fits & _calm("facts1", "facts2") & (F.col("id1") != F.col("id2")))
    return met.where(F.col("named") | _kin("ident1", "ident2")).select("id1", "id2").distinct()


def overlaps(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(id1, id2, share1, share2): cards of ``evaluation`` and ``training`` (id, name, attributes) that are nearly the same.

    ``share1`` and ``share2`` are the shared parts of either record's length.  Cards that both
    state a code, colour, measure or pack size and disagree are left out, as are cards whose
    brand and line words have nothing in common.  Named alike (code, or brand and line), cards
    need NEAR_NAMED in common, else NEAR.  Nulls state nothing; a card without any
    chunk pairs with none.  Equal ids are left to the caller.
    """
    # one reading of both sides: what either teaches about words holds for both
    sided = lambda df, s: df.select(F.lit(s).alias("side"), "id", "name", "attributes")
    both = chunked(sided(evaluation, 1).unionByName(sided(training, 2))).where(F.size("chunks") > 0)
    left, right = both.where("side = 1"), both.where("side = 2")
    # only chunks that both sides have can be shared; their rarity is counted over both
    seen = both.select("side", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("df"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    rarity = cut(seen.where("lo < hi").select("chunk", "df"), "rarity")
    met = cut(candidates(left, right, rarity), "candidates")
    release(evaluation.sparkSession)  # the prefixes are far longer than the pairs
    one = lambda x, n: x.select(*[F.col(c).alias(f"{c}{n}") for c in ("id", "chunks", "sizes", "names", "ident")])
    pairs = met.join(one(left, 1), "id1").join(one(right, 2), "id2")
    total = lambda n: F.aggregate(f"sizes{n}", F.lit(0), lambda s, x: s + x)
    common = F.aggregate(F.filter(F.arrays_zip("chunks1", "sizes1"), lambda z: F.array_contains("chunks2", z.chunks1)), F.lit(0), lambda s, z: s + z.sizes1)
    scored = pairs.withColumn("common", common).withColumn("share1", F.col("common") / total(1)).withColumn("share2", F.col("common") / total(2))
    low = F.least("share1", "share2")
    alike = _heavy(F.array_intersect("names1", "names2")) >= ALIKE
    near = ((low >= NEAR) & _kin("ident1", "ident2")) | (alike & (low >= NEAR_NAMED))
    return scored.where(near).select("id1", "id2", "share1", "share2")


def leaked_cards(hardval: DataFrame, hardval_items: DataFrame, training_pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(id1, id2, share1, share2): id1 used in ``hardval`` and id2 in ``training_pairs``, the same id or nearly the same card.

    Cards of the evaluation set are read from ``hardval_items`` and, where missing there, from ``items``.
    """
    h, t = cut(pair_ids(hardval), "ids"), cut(pair_ids(training_pairs), "ids")
    same = h.join(t, "id").select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("share1"), F.lit(1.0).alias("share2"))
    near = overlaps(cards_of(h, hardval_items, items), cards_of(t, items))
    return same.unionByName(near)


def overlap_report(found: DataFrame, hardval_items: DataFrame, items: DataFrame) -> DataFrame:
    """(category, seller_id, eval_cards, pairs): overlaps by the evaluation card's category and the training card's seller."""
    category = hardval_items.where("id is not null").groupBy(F.col("id").alias("id1")).agg(F.min("category").alias("category"))
    seller = items.where("id is not null").groupBy(F.col("id").alias("id2")).agg(F.min("seller_id").alias("seller_id"))
    joined = found.join(category, "id1", "left").join(seller, "id2", "left")
    return joined.groupBy("category", "seller_id").agg(F.count_distinct("id1").alias("eval_cards"), F.count(F.lit(1)).alias("pairs"))
