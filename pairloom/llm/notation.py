"""Problem 1: records that say the same in another notation.

Progressive partition refinement.  Every row gets a cheap invariant in the JVM (the stripped
name and category).  Only rows whose invariant is shared by several ids go on to the costly
key: the parsed, sorted and stripped record.  The refinement is lossless because the
invariant ignores all that the key ignores; attributes are left to the key, as a field may be
written twice, escaped or as a number without changing what they say.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.workspace import cut

_DECIMAL = re.compile(r"(?<=\d)[.,](?=\d)")
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case, letters and digits only; a decimal sign between digits stays, as a point."""
    text = _DECIMAL.sub("\x02", text.lower())
    if "\x02" not in text:
        return _OTHER.sub("", text)
    return ".".join(_OTHER.sub("", part) for part in text.split("\x02"))


def _value(value: object) -> str:
    if isinstance(value, _Pairs):
        return "{" + "\x03".join(sorted({f"{fold(k)}\x01{_value(v)}" for k, v in value.items})) + "}"
    if isinstance(value, list):
        return "[" + "\x03".join(map(_value, value)) + "]"
    return fold({True: "true", False: "false", None: "null"}.get(value, value)) if not isinstance(value, str) else fold(value)


class _Pairs:
    """A JSON object with all its fields, repeated keys included."""

    def __init__(self, items: list):
        self.items = items


def record_key(name: str | None, category: str | None, attributes: str | None) -> bytes:
    """Digest of a record up to case, white space, punctuation and the notation of its JSON.

    Null and a text without letters or digits are the same.  Attributes that are no JSON
    object count as plain text, which no object equals unless it is empty.
    """
    fields = ""
    if attributes:
        try:
            parsed = json.loads(attributes, object_pairs_hook=_Pairs, parse_float=str, parse_int=str, parse_constant=str)
        except ValueError:
            parsed = attributes
        if isinstance(parsed, _Pairs):
            fields = "\x03".join(sorted({f"{fold(k)}\x01{_value(v)}" for k, v in parsed.items}))
        else:
            text = fold(attributes)
            fields = f"\x04{text}" if text else ""
    whole = f"{fold(name or '')}\x00{fold(category or '')}\x00{fields}"
    return hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("name", "category", "attributes")]
        keys = pa.array([record_key(*row) for row in zip(*columns, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), keys], ["id", "record_key"])


def invariant(name: Column, category: Column) -> Column:
    """Hash of the letters and digits of name and category; upper case last, which is alike for all forms of a letter."""
    bare = lambda c: F.upper(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]+", ""))
    return F.xxhash64(bare(name), bare(category))


def notation_keys(items: DataFrame) -> DataFrame:
    """(id, record_key), distinct, of every record whose invariant another id shares.

    ``items`` needs id, name, category, attributes; other columns are ignored.  Rows with a
    null id are no records.  An empty table gives an empty result.
    """
    rows = items.select("id", "name", "category", "attributes").where(F.col("id").isNotNull())
    marked = cut(rows.select("id", invariant(F.col("name"), F.col("category")).alias("inv")), "invariants")
    shared = marked.groupBy("inv").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("inv")
    several = marked.join(shared, "inv", "left_semi").select("id").distinct()
    texts = rows.join(several, "id", "left_semi")
    return texts.mapInArrow(_keys, "id bigint, record_key binary").distinct()


def notation_classes(items: DataFrame) -> DataFrame:
    """(id, class_id, copies) of every record that has a copy in another notation.

    ``class_id`` is the smallest id of the class, ``copies`` its number of distinct ids.
    """
    keys = cut(notation_keys(items), "keys")
    classes = keys.groupBy("record_key").agg(F.min("id").alias("class_id"), F.count("id").alias("copies")).where("copies > 1")
    return keys.join(classes, "record_key").select("id", "class_id", "copies")


def notation_pairs(items: DataFrame) -> DataFrame:
    """(id1, id2), id1 < id2: every pair of records equal but for notation.

    The join is on the class; AQE splits a class that is skewed.
    """
    member = cut(notation_classes(items).select("id", "class_id"), "members")
    left, right = member.select(F.col("id").alias("id1"), "class_id"), member.select(F.col("id").alias("id2"), "class_id")
    return left.join(right, "class_id").where("id1 < id2").select("id1", "id2")


def collapsed(items: DataFrame) -> DataFrame:
    """(class_id, copies): one row per record of ``items`` after collapsing, with its number of copies."""
    classes = notation_classes(items)
    alone = items.select(F.col("id").alias("class_id")).where("class_id is not null").distinct()
    alone = alone.join(classes.select(F.col("id").alias("class_id")), "class_id", "left_anti")
    return alone.withColumn("copies", F.lit(1).cast("bigint")).unionByName(classes.select("class_id", "copies").distinct())
