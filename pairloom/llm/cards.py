"""Reading a product card: the facts that tell one article from another.

A card is a name and a JSON text of attributes.  ``read_cards`` turns it into one thin row:
identity words (brand and line in one script), article code, colour, one measure in base
units, and pieces per pack.  The corpus is parsed once in Arrow batches; the same pass counts
what its attributes use as words of kinds, colours, units and packs, as shapes of article
codes, and which words names have beside brand and line.  A second pass over the thin rows
reads the names by what was learned; everything after it is JVM-side.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from pairloom.llm.notation import fold
from pairloom.workspace import Table, cut, write_table

# Attribute names by the fact they state.
KEY_FACTS = {
    "brand": ["бренд", "бренд в одежде и обуви", "торговая марка", "производитель"],
    "kind": ["тип", "тип товара"],
    "line": ["серия", "линейка", "модель"],
    "code": ["артикул", "код товара", "партномер", "артикул производителя"],
    "colour": ["цвет", "цвет товара", "название цвета"],
    "pack": ["количество в упаковке", "единиц в одном товаре", "количество, штук"],
    "stuff": ["материал", "материал изделия", "состав"],
    "length": ["длина"],
    "volume": ["объем"],
    "mass": ["вес товара"],
    "power": ["мощность"],
    "size": ["размер", "размер ru", "российский размер"],
}
# Units, their dimension and their factor to the base unit.
UNITS = {
    "мм": ("length", 1), "см": ("length", 10), "м": ("length", 1000), "mm": ("length", 1), "cm": ("length", 10),
    "мл": ("volume", 1), "л": ("volume", 1000), "ml": ("volume", 1),
    "г": ("mass", 1), "гр": ("mass", 1), "кг": ("mass", 1000), "kg": ("mass", 1000),
    "вт": ("power", 1), "квт": ("power", 1000),
}
# Translations of colours, as the stem of the Russian adjective and the English word.
COLOURS = {
    "красн": "red", "розов": "pink", "бордов": "burgundy", "бежев": "beige", "сер": "grey", "бел": "white", "син": "blue",
    "фиолетов": "purple", "оранжев": "orange", "желт": "yellow", "черн": "black", "зелен": "green", "голуб": "light blue", "коричнев": "brown",
}
# Endings of the adjectives above.
ENDINGS = ["ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие"]
# Words of advertising, packing and form that name no article.
FILLER = set(
    "в с от и для из на подарок подарочная упаковка хит продаж успей купить бестселлер сезона лучший выбор супер цена всей семьи универсальный "
    "производителя доставкой премиум качество дома дачи скидка топ акция new sale новинка новый выгодно оригинал набор комплект шт штук штуки "
    "товар размер р ru".split()
)
# What stands for a missing value.
NO_VALUE = {"", "-", "нет", "без бренда", "нет бренда", "не определен", "не указан", "не указано"}
# Cyrillic to Latin.
LATIN = dict(
    zip(
        "абвгдезийклмнопрстуфхцыэъь",
        ["a", "b", "v", "g", "d", "e", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "y", "e", "", ""],
        strict=True,
    )
) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya"}
# Cyrillic letters that look like Latin ones, as they stray into article codes.
LOOKALIKE = dict(zip("авекмнорстху", "abekmhopctxy", strict=True))

_LATIN, _LOOKALIKE = str.maketrans(LATIN), str.maketrans(LOOKALIKE)
_FACT = {key: fact for fact, keys in KEY_FACTS.items() for key in keys}
_COLOUR = {stem + end: word for stem, word in COLOURS.items() for end in ENDINGS} | {word: word for word in COLOURS.values()} | {"gray": "grey"}
_TOKEN = re.compile(r"\d+(?:[.,]\d+)?|[a-zа-я]+")
_FIELD = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?)(?=\s*[,}])')
DIGIT, LETTER = r"\d", "[a-zа-я]"
_MEASURES = ("length", "volume", "mass", "power")

#: What the attributes of fewer cards state is not taken for a word of its kind.
SEEN = 2
#: A code shape counts if at least this part of all codes have it, a name's further word if it is beside brand and line in this part of the names.
SHAPE_SHARE, FURTHER_SHARE = 0.01, 0.003
#: Up to this many learned words, of all roles, are sent to the workers; more are joined to the cards that use them, with the same result.
SENT_WORDS = 100_000
#: Words up to this long are compared by what they are without one letter; the few longer ones letter by letter, with the same result.
LONG = 64

STATED = "id bigint, name string, brand string, line string, code string, colour string, dim string, amount double, pack int, kind string, bare string"
CARD = "id bigint, ident array<string>, code string, bare string, colour string, dim string, amount double, pack int, fact binary"
_STATED = [c.split()[0] for c in STATED.split(", ")]
_CARD = [c.split()[0] for c in CARD.split(", ")]
_ROLES = {role[0]: role for role in ("known", "colours", "units", "packs")}


def latin(word: str) -> str:
    """A word in Latin letters, the spellings of one sound joined."""
    return word.translate(_LATIN).replace("ks", "x")


def colour_word(word: str) -> str:
    """A colour's English word where there is a translation, else the word without the ending of an adjective."""
    if word in _COLOUR:
        return _COLOUR[word]
    return next((word[: -len(e)] for e in ENDINGS if word.endswith(e) and len(word) > len(e) + 2), word)


class _Cache(dict):
    """Results by raw text; emptied when it has grown large."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        if len(self) > 50_000:
            self.clear()
        self[key] = value = self.f(key)
        return value


def _plain(text: str) -> str:
    return " ".join(text.lower().replace("ё", "е").split()).strip(" ;:.,")


def _key(raw: str) -> tuple[str | None, str | None]:
    text = _plain(raw)
    if text in _FACT:
        return _FACT[text], None
    stem, _, unit = text.partition(",")
    fact = _FACT.get(stem.strip())
    return (fact, unit.strip()) if fact in _MEASURES and unit.strip() else (None, None)


def _measure(number: str, unit: str) -> tuple[str, float]:
    """Dimension and amount in its base unit; a unit without a factor is a dimension of its own."""
    dim, factor = UNITS.get(unit, (unit, 1))
    return dim, round(float(number.replace(",", ".")) * factor, 3)


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _alike(a: str, b: str) -> bool:
    """Whether two words are one without one letter of the other, or both the same without one letter; needs no room."""
    if len(a) > len(b):
        a, b = b, a
    n, same, end = len(a), 0, 0
    if len(b) - n > 1:
        return False
    while same < n and a[same] == b[same]:
        same += 1
    if len(b) > n:
        return a[same:] == b[same + 1 :]
    while end < n - same and a[n - 1 - end] == b[n - 1 - end]:
        end += 1
    a, b = a[same : n - end], b[same : n - end]
    return len(a) < 2 or a[1:] == b[:-1] or a[:-1] == b[1:]


def _shape(tokens: list[str]) -> str:
    """Kinds and lengths of tokens, such as 'a3 d5'; empty where a number has a decimal sign."""
    if any(not t.isalnum() for t in tokens):
        return ""
    return " ".join(f"{'d' if t[0].isdigit() else 'a'}{len(t)}" for t in tokens)


class AttributeReader:
    """Reads attributes, and counts what they teach about names."""

    def __init__(self):
        self.keys = _Cache(_key)
        self.latin = _Cache(latin)
        self.words = _Cache(lambda text: [] if (plain := _plain(text)) in NO_VALUE else _TOKEN.findall(plain))
        self.folded = _Cache(fold)
        self.seen: dict[str, Counter[str]] = {role: Counter() for role in ("shape", "colour", "pack", "unit", "further", "names")}
        self.kinds: Counter[str] = Counter()  # by whole value: their words are counted at the end

    def counts(self) -> list[tuple[str, str, int]]:
        """(role, word, n) of all that was counted."""
        found: Counter[tuple[str, str]] = Counter({(role, word): n for role, words in self.seen.items() for word, n in words.items()})
        for text, n in self.kinds.items():
            for word in set(self.words[text]):
                if len(word) > 1:
                    found["kind", word] += n
        return [(role, word, n) for (role, word), n in found.items()]

    def code(self, tokens: list[str]) -> str:
        return "".join(tokens).translate(_LOOKALIKE)

    def _fields(self, attributes: str | None) -> list[tuple[str, object]]:
        if not attributes:
            return []
        try:
            parsed = json.loads(attributes)
        except ValueError:
            return [(k, v.strip('"')) for k, v in _FIELD.findall(attributes)]  # the whole fields of a cut-off object
        return list(parsed.items()) if isinstance(parsed, dict) else []

    def bare(self, name: str | None, category: str | None, attributes: str | None) -> str:
        """Digest of a whole card that is equal for cards that differ in notation only."""
        folded = self.folded
        fields = {f"{folded[k]}\x01{folded[v if isinstance(v, str) else str(v)]}" for k, v in self._fields(attributes)}
        text = "\x03".join(sorted(fields)) if fields else "\x04" + fold(attributes or "")
        return blake2b(f"{fold(name or '')}\x00{folded[category or '']}\x00{text}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def read(self, name: str | None, attributes: str | None) -> tuple:
        """(name tokens, brand, line, code, colour, dim, amount, pack, kind words); what is not stated is None or empty."""
        brand = line = code = colour = dim = pack = amount = None
        kind: list[str] = []
        seen, kinds, words, spelt = self.seen, self.kinds, self.words, self.latin
        for raw, value in self._fields(attributes):
            fact, unit = self.keys[raw]
            if fact is None or value is None or isinstance(value, (dict, list, bool)):
                continue
            text = value if isinstance(value, str) else str(value)
            tokens = words[text]
            if not tokens:
                continue
            if fact == "brand":
                brand = "".join([spelt[t] for t in tokens])
            elif fact == "line":
                line = "".join([spelt[t] for t in tokens])
            elif fact == "code":
                code = self.code(tokens)
                seen["shape"][_shape(tokens)] += 1
            elif fact == "colour":
                colour = next((_COLOUR[t] for t in tokens if t in _COLOUR), None)
                if colour is None:
                    colour = " ".join(map(colour_word, tokens))
                    if len(tokens) == 1:
                        seen["colour"][colour] += 1
            elif fact == "pack":
                pack = int(tokens[0]) if tokens[0].isdigit() and len(tokens[0]) < 9 else pack
                if len(tokens) == 2 and pack is not None and not tokens[1][0].isdigit():
                    seen["pack"][tokens[1]] += 1
            elif fact == "size":
                dim, amount = next((("size", float(t.replace(",", "."))) for t in tokens if t[0].isdigit()), (dim, amount))
            elif fact in _MEASURES:
                if tokens[0][0].isdigit():
                    own = tokens[1] if len(tokens) > 1 and not tokens[1][0].isdigit() else unit
                    if own is not None:
                        dim, amount = _measure(tokens[0], own)
                        if own not in UNITS:
                            seen["unit"][own] += 1
            else:
                kind += tokens
                kinds[text] += 1
        tokens = _TOKEN.findall(name.lower().replace("ё", "е")) if name else []
        if brand and line:
            seen["names"][""] += 1
            further = seen["further"]
            for t in set(tokens):
                if len(t) > 1 and not t[0].isdigit() and t not in kind and spelt[t] != brand and spelt[t] != line:
                    further[t] += 1
        return tokens, brand, line, code, colour, dim, amount, pack, kind


@dataclass
class Lexicon:
    """What the corpus teaches: words that name no article, colours, units and words for pieces, and shapes of codes."""

    known: set[str] = field(default_factory=set)
    colours: set[str] = field(default_factory=set)
    units: set[str] = field(default_factory=set)
    packs: set[str] = field(default_factory=set)
    shapes: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.units = self.units | set(UNITS)
        self.packs = self.packs | {"шт", "штук", "штуки"}
        self.known = self.known | FILLER | self.units | self.packs
        self.long = [w for w in self.known if len(w) > LONG]
        parts = [shape.split() for shape in self.shapes if shape]
        long = [p for p in parts if sum(int(x[1:]) for x in p if x[0] == "d") >= (3 if len(p) > 1 else 5)]
        each = [" ".join(f"{DIGIT if x[0] == 'd' else LETTER}{{{x[1:]}}}" for x in p) for p in sorted(long, key=len, reverse=True)]
        self.code = re.compile(rf"(?<!\S)(?:{'|'.join(each)})(?!\S)") if each else None

    @cached_property
    def near(self) -> set[str]:
        """Known words without one letter; made where it is used, as it is ten times the words."""
        return {d for w in self.known if 4 < len(w) <= LONG for d in _deletions(w)}


class NameReader:
    """Reads names, given the lexicon and what the attributes state."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.latin = _Cache(latin)
        self.colour = _Cache(lambda w: _COLOUR.get(w) or (c if (c := colour_word(w)) in self.lexicon.colours else None))

    def _misspelt(self, word: str) -> bool:
        if len(word) >= LONG and any(_alike(word, w) for w in self.lexicon.long):
            return True
        known, near = self.lexicon.known, self.lexicon.near
        return 4 < len(word) <= LONG + 1 and (word in near or any(d in known or d in near for d in _deletions(word)))

    def read(self, name, brand, line, code, colour, dim, amount, pack, kind) -> tuple:
        """(ident, code, colour, dim, amount, pack); what the card doesn't state is None, ident may be empty.

        ``name`` and ``kind`` are tokens with blanks between.
        """
        lexicon = self.lexicon
        known, units, packs, colours = lexicon.known, lexicon.units, lexicon.packs, self.colour
        if lexicon.code is not None and (met := lexicon.code.search(name)):
            if code is None:
                code = met.group().replace(" ", "").translate(_LOOKALIKE)
            name = lexicon.code.sub("", name)
        tokens, kinds, words = name.split(), kind.split(), []
        named = not (brand and line)
        i, n = 0, len(tokens)
        while i < n:
            t = tokens[i]
            if t[0].isdigit():
                before, after = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < n else ""
                if after in packs or before == "из" or before == "набор":
                    if pack is None and t.isdigit() and len(t) < 9:
                        pack = int(t)
                elif after in units:
                    if dim is None:
                        dim, amount = _measure(t, after)
                    i += 1
                elif (after == "ru" or before in ("р", "размер")) and dim is None:
                    dim, amount = "size", float(t.replace(",", "."))
            elif colours[t]:
                if colour is None:
                    colour = colours[t]
            elif named and t not in known and len(t) > 1 and t not in kinds:
                words.append(t)
            i += 1
        if brand and line:
            ident = {brand, line}
        else:
            sure = brand or line
            rest = {self.latin[w]: w for w in words}
            rest.pop(sure, None)
            if len(rest) > (1 if sure else 2):
                rest = {k: w for k, w in rest.items() if not self._misspelt(w)} or rest
            if sure and len(rest) > 1:
                rest = {k: w for k, w in rest.items() if not _alike(sure, k)} or rest
            ident = set(rest) | ({sure} if sure else set())
        return sorted(ident), code, colour, dim, amount, pack


def stated(cards: DataFrame, further: Callable | None = None, schema: str = "") -> DataFrame:
    """One row (STATED) per row of ``cards`` (id, name, category, attributes), and rows (role, word, n) of what was counted.

    ``further`` maps lists of names and attributes to Arrow arrays, added under the names and
    kinds of ``schema``; columns of ``schema`` that the cards have are passed on.  The counts of a
    partition follow its cards; their id is null.
    """
    passed = [f.name for f in _parse_datatype_string(schema) if f.name in cards.columns] if schema else []
    whole = ", ".join(x for x in (STATED, schema, "role string, word string, n bigint") if x)
    target = to_arrow_schema(_parse_datatype_string(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = AttributeReader()

        def batch_of(columns: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in target], schema=target)

        for batch in batches:
            names, categories, texts = (batch.column(c).to_pylist() for c in ("name", "category", "attributes"))
            rows = [reader.read(n, a) for n, a in zip(names, texts, strict=True)]
            tokens, brand, line, code, colour, dim, amount, pack, kind = zip(*rows, strict=True) if rows else ([],) * 9
            bare = [reader.bare(n, c, a) if not r[3] and not (r[1] and r[2]) else None for r, n, c, a in zip(rows, names, categories, texts, strict=True)]
            columns = dict(zip(_STATED, [batch.column("id"), [" ".join(t) for t in tokens], brand, line, code, colour, dim, amount, pack, [" ".join(k) for k in kind], bare], strict=True))
            yield batch_of(columns | {c: batch.column(c) for c in passed} | (further(names, texts) if further else {}), len(rows))
        counts = reader.counts()
        if counts:
            role, word, n = zip(*counts, strict=True)
            yield batch_of({"role": role, "word": word, "n": n}, len(counts))

    return cards.select("id", "name", "category", "attributes", *passed).where("id is not null").mapInArrow(run, whole)


def learned(table: DataFrame) -> DataFrame:
    """(role, word): what the counts of ``table`` (see stated) teach; roles are those of Lexicon.

    A word of a kind, colour, unit or pack must be stated by SEEN cards, a code shape by
    SHAPE_SHARE of the codes, and a further word by FURTHER_SHARE of the names counted.
    """
    counts = table.where("role is not null").groupBy("role", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "counts")
    sums = {r.role: r.n for r in counts.where("role in ('shape', 'names')").groupBy("role").agg(F.sum("n").alias("n")).collect()}
    least = F.when(F.col("role") == "shape", sums.get("shape", 0) * SHAPE_SHARE).when(F.col("role") == "further", sums.get("names", 0) * FURTHER_SHARE).otherwise(0)
    role = F.when(F.col("role").isin("kind", "further"), "known").otherwise(F.concat("role", F.lit("s")))
    return counts.where(F.col("role") != "names").where(F.col("n") >= F.greatest(least, F.lit(SEEN))).select(role.alias("role"), "word").distinct()


def _lexicon(rows) -> Lexicon:
    parts: dict[str, set[str]] = {}
    for role, word in rows:
        parts.setdefault(role, set()).add(word)
    return Lexicon(**parts)


def _with_hints(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``hints``: the learned words, as text, that a card's name has or nearly has (one letter more, less or other).

    A hint is the first letter of the role and the word.  Words are met once for each distinct
    word of the names, colours also without the ending of an adjective.
    """
    spelt = lambda w: F.concat(F.array(w), F.when(F.length(w).between(5, LONG + 1), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>")))
    word, long = F.col("word"), F.length("word") >= LONG
    hint = F.concat(F.substring("role", 1, 1), "word").alias("hint")
    forms = words.select(hint, F.explode(F.array_distinct(F.when(F.col("role") == "colours", F.array(word)).otherwise(spelt(word)))).alias("form"))
    used = rows.select("id", F.xxhash64("name").alias("h"), F.explode(F.array_distinct(F.split("name", " "))).alias("word")).where("word <> ''")
    each = used.select("word").distinct()
    stem = F.when(F.length(word) > 4, F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(word)
    met = each.select("word", F.explode(F.array_distinct(F.concat(spelt(word), F.array(stem)))).alias("form")).join(forms, "form").select("word", "hint")
    far = words.where(long & (F.col("role") != "colours")).select(hint, F.length("word").alias("n"))  # few by nature; the reader compares them
    met = met.unionByName(each.where(long).select("word", F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1)).alias("n")).join(far, "n").select("word", "hint"))
    near = met.groupBy("word").agg(F.collect_set("hint").alias("hints"))
    found = used.join(near, "word").groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.array_join(F.array_distinct(F.flatten(F.collect_list("hints"))), " ").alias("hints"))
    return rows.join(found, (rows.id == F.col("_id")) & (F.xxhash64(rows.name) == F.col("_h")), "left").drop("_id", "_h")


def read_cards(cards: DataFrame, further: Callable | None = None, schema: str = "", sent: int = SENT_WORDS) -> Table:
    """One thin row (CARD, and the columns of ``schema``) per row of ``cards`` (id, name, category, attributes) with an id.

    ``bare`` is a digest of the whole record, for cards that state neither two identity
    words nor a code; ``fact`` a digest of all facts.  Null or broken columns read as nothing
    stated.  ``further`` is as in ``stated``.  If there are more than ``sent`` learned words, they
    are joined to the cards by their spelling, not sent, with the same result.
    """
    source = write_table(stated(cards, further, schema), "stated")
    table, words = source.df, cut(learned(source.df), "lexicon")
    rows = table.where("id is not null").drop("role", "word", "n")
    shape = F.col("role") == "shapes"  # at most 1 / SHAPE_SHARE, all of them sent
    few = words.where(~shape).count() <= sent
    lexicon = _lexicon((r.role, r.word) for r in (words if few else words.where(shape)).collect())
    rows = rows.withColumn("hints", F.lit(None).cast("string")) if few else _with_hints(rows, words.where(~shape))
    own = [f.name for f in _parse_datatype_string(schema)] if schema else []
    whole = ", ".join(x for x in (CARD, schema) if x)
    target = to_arrow_schema(_parse_datatype_string(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = NameReader(lexicon)
        sent_shapes = [("shapes", x) for x in lexicon.shapes]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_STATED[1:10], "bare", "hints")]
            rows = []
            for name, brand, line, code, colour, dim, amount, pack, kind, bare, hints in zip(*columns, strict=True):
                if not few:
                    reader.lexicon = _lexicon([*sent_shapes, *((_ROLES[h[0]], h[1:]) for h in (hints or "").split())])
                found = reader.read(name, brand, line, code, colour, dim, amount, pack, kind)
                bare = bare if not found[1] and len(found[0]) < 2 else None
                rows.append((found[0], found[1], bare, *found[2:], blake2b(repr((found, bare)).encode("utf-8", "surrogatepass"), digest_size=16).digest()))
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 8, list(target)[1:9], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, *(batch.column(c) for c in own)], schema=target)

    done = write_table(rows.mapInArrow(run, whole), "cards")
    source.drop()
    return done
