"""Card text, content fingerprints and token sets as Column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the white space that the reference's language strips and collapses.
WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Attributes that come first in a card's text, in this order.
PRIORITY_KEYS = [
    "бренд", "бренд в одежде и обуви", "торговая марка", "тип", "модель", "артикул", "партномер (артикул производителя)", "артикул производителя", "oem-номер", "oe-код", "цвет",
    "цвет товара", "название цвета", "размер", "российский размер", "объем, мл", "объем", "вес товара, г", "состав", "материал", "количество, штук", "единиц в одном товаре",
]
# What counts as no value in the priority pass.
NO_VALUE = ["нет", "-"]
# Attributes left out of prompt cards, and those that come first in them.
PROMPT_DROP = "образец цвета|инструкция по уходу|уход за вещами|условия хранения|о драгоценном металле|примечание|дополнительная информация|гарантийн|срок службы|валюта|признак 18|информация о размерах|описание|вид выпуска товара|страна бренда|целевая аудитория$"
PROMPT_KEYS = [
    "артикул", "артикул производителя", "партномер (артикул производителя)", "партномер", "oem-номер", "оем номер", "модель", "код товара", "альтернативные артикулы товара", "тип", "бренд",
    "бренд в одежде и обуви", "цвет товара", "цвет", "название цвета", "объем, мл", "объем", "объем товара", "объём", "количество в упаковке", "количество в упаковке, шт", "единиц в одном товаре",
    "количество предметов в упаковке", "количество, штук", "комплектация", "состав", "в наборе", "вес товара, г", "вес, кг", "вес", "материал", "материал изделия", "размеры, мм", "размеры (вxшxг)",
    "высота, см", "ширина, см", "глубина, см", "длина, см", "высота предмета", "ширина предмета", "глубина предмета", "диаметр, мм",
]
# Labels of the two parts of a prompt card.
PROMPT_NAME, PROMPT_ATTRIBUTES = "Название: ", "Атрибуты: "


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(c, f"{WHITE}+", " ")


def fingerprint(name: Column, attributes: Column, category: Column) -> Column:
    """md5 of the card's content; missing texts count as the word none, a missing category as None."""
    part = lambda c: strip(F.lower(F.coalesce(c, F.lit("None"))))
    return F.md5(collapse(F.concat_ws("|", part(name), part(attributes), F.coalesce(category, F.lit("None")))))


def raw_entries(attributes: Column) -> Column:
    """array<struct<key, value>> of a JSON object in its order; empty for null, broken or other JSON."""
    parsed = F.map_entries(F.from_json(attributes, "map<string,string>"))
    return F.coalesce(parsed, F.array().cast("array<struct<key:string,value:string>>"))


def with_entries(df: DataFrame, out: str = "entries", attributes: str = "attributes", normalised: bool = True) -> DataFrame:
    """``df`` with ``out``: array<struct<k, v>> of a JSON object; of equal keys the first place and the last value.

    With ``normalised`` keys are stripped and in lower case and values stripped.  A JSON null
    reads as None, as in the reference; nested values and booleans keep their JSON text.  The
    steps are columns of their own: later expressions refer to the parsed result often, and
    Catalyst would otherwise parse again for each.
    """
    value = lambda e: F.coalesce(e.value, F.lit("None"))
    if normalised:
        pair = lambda e: F.struct(F.lower(strip(e.key)).alias("k"), strip(value(e)).alias("v"))
    else:
        pair = lambda e: F.struct(e.key.alias("k"), value(e).alias("v"))
    staged = df.withColumn("_raw", raw_entries(F.col(attributes))).withColumn("_pairs", F.transform("_raw", pair)).withColumn("_keys", F.array_distinct(F.transform("_pairs", lambda p: p.k)))
    last = lambda k: F.try_element_at(F.filter("_pairs", lambda p: p.k == k), F.lit(-1))
    merged = F.when(F.size("_keys") == F.size("_pairs"), F.col("_pairs")).otherwise(F.transform("_keys", lambda k: F.struct(k.alias("k"), last(k).v.alias("v"))))
    return staged.withColumn(out, merged).drop("_raw", "_pairs", "_keys")


def _ordered(entries: Column, order: list[str], leads: Callable[[Column], Column]) -> Column:
    """``entries`` with those of ``order`` that lead first, in its order, then the rest as they are."""
    keys = F.array(*[F.lit(k) for k in order])
    place = lambda e: F.array_position(keys, e.k)
    placed = F.transform(entries, lambda e, i: F.struct(F.when((place(e) > 0) & leads(e), place(e)).otherwise(F.lit(1000) + i).cast("bigint").alias("at"), e.k.alias("k"), e.v.alias("v")))
    return F.array_sort(placed)


def card_text(name: Column, category: Column, entries: Column, cap: int, value_cap: int = 60) -> Column:
    """'category | name | k=v; k=v' with the priority attributes first; the joined attributes are cut at ``cap``.

    ``entries`` is the column of with_entries.  A priority attribute whose value says nothing
    loses its place and comes with the rest.
    """
    said = F.filter(entries, lambda e: e.v != "")
    parts = F.transform(_ordered(said, PRIORITY_KEYS, lambda e: ~F.lower(e.v).isin(NO_VALUE)), lambda e: F.concat(e.k, F.lit("="), F.substring(e.v, 1, value_cap)))
    return F.concat_ws(" | ", F.coalesce(category, F.lit("None")), F.coalesce(name, F.lit("None")), F.substring(F.array_join(parts, "; "), 1, cap))


def prompt_card(name: Column, entries: Column, max_attributes: int = 28, value_cap: int = 120, block_cap: int = 1200, name_cap: int = 220) -> Column:
    """The card as an annotator's prompt shows it: name, then up to ``max_attributes`` attributes, telling ones first.

    ``entries`` is the column of with_entries(normalised=False).
    """
    kept = F.filter(entries, lambda e: (strip(e.v) != "") & ~e.k.rlike(PROMPT_DROP))
    shown = F.transform(F.slice(_ordered(kept, PROMPT_KEYS, lambda e: F.lit(True)), 1, max_attributes), lambda e: F.concat(e.k, F.lit(": "), F.substring(e.v, 1, value_cap)))
    block = F.substring(F.array_join(shown, "; "), 1, block_cap)
    return F.concat(F.lit(PROMPT_NAME), F.substring(F.coalesce(name, F.lit("None")), 1, name_cap), F.lit("\n" + PROMPT_ATTRIBUTES), block)


def text_category(text: Column) -> Column:
    """The category that leads a card text; null for a null text."""
    return F.substring_index(text, " | ", 1)


def name_tokens(name: Column) -> Column:
    """Distinct lower-case runs of Latin and Cyrillic letters and digits; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-zа-яё0-9]+"), F.lit(0)))


def words(text: Column) -> Column:
    """Distinct white-space separated words."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), lambda w: w != ""))


def set_jaccard(a: Column, b: Column, empty: float) -> Column:
    """Jaccard of two arrays of distinct values; ``empty`` where either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(common / (F.size(a) + F.size(b) - common))
