"""Problem 10: template residue, filler and error-page text.

Two regularised linear classifiers on hashed n-grams, length and title features.  Weak labels
come from phrases (status lines, script demands, filler) and from the notations of template
slots.  One classifier judges whole documents (is this a message or filler in place of
content?), the other single passages around special characters (is this an unfilled slot?).
The scores alone decide; the phrases and notations label the bounded sample both are fitted
on and nothing else.  Validation is on sources, and on notations, that training never saw.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.mixing import source_key
from pairloom.operators.sampling import portable_int
from pairloom.workspace import write_table

#: Labels and features are made of at most about this many documents (by hash of their ids),
SAMPLE_DOCS = 20_000
#: and at most so many rows of either classifier and label are used for fitting; a row has at most DIMS features.
SAMPLE_ROWS = 6_000
#: Hashed feature dimensions, ridge penalty, and steps of the solver.
DIMS, PENALTY, STEPS = 1 << 16, 3e-6, 150
#: Part of a text that weak phrases must cover for a positive label.
COVER = 0.3
#: A text of at least so many words, of which at most this part are distinct, is filler.
MONOTONE_WORDS, MONOTONE_PART = 20, 0.5
#: Scores from which a text is a message, and a passage a slot.
MESSAGE, SLOT = 0.5, 0.6
#: One source in so many is kept for validation.
HELD_OUT = 4

# Phrases of status pages, script demands, access checks and filler.
PHRASES = [
    r"javascript", r"включите скрипт\w*", r"скрипты отключены", r"разрешите выполнение скриптов", r"нужны скрипты", r"scripts? (?:is|are) required", r"enable (?:client-side )?scripting", r"turn on scripts", r"ohne skripte", r"без js\b", r"поддержк\w+ js\b", r"noscript", r"не поддерживает скрипты",
    r"\b(?:error|ошибка|http|code|ответил) ?[45]\d\d\b", r"\b[45]\d\d (?:bad gateway|not found|forbidden|internal|service|gateway)\b", r"bad gateway", r"internal server error", r"gateway timeout", r"page not found", r"страница не найдена", r"seite nicht gefunden", r"service unavailable", r"nicht verfügbar", r"временно недоступ\w+", r"could not be loaded", r"не удалось загрузить", r"не загрузил\w+", r"ошибка соединения", r"время ожидания", r"технически\w+ работ\w+", r"under maintenance", r"wartungsarbeiten", r"что-то пошло не так", r"не найден[аоы]?\b", r"not found", r"nicht gefunden", r"проверьте адрес", r"check the address", r"товар удал[её]н", r"скрыт продавцом", r"has been removed", r"no longer available", r"wurde entfernt", r"вернуться (?:в каталог|назад)", r"liegt keine antwort vor", r"fehler [45]\d\d", r"traceback \(most recent", r"\w+exception at", r"keyerror", r"fatal:",
    r"access denied", r"доступ ограничен", r"доступ запрещ\w+", r"сессия истекла", r"не робот", r"слишком много запросов", r"превышен лимит", r"request id [0-9a-f]+", r"запрос [0-9a-f]{8,}", r"код события [0-9a-f]{8,}", r"ничего нет: [0-9a-f]+",
    r"lorem ipsum", r"ваш текст", r"пример текста", r"placeholder copy", r"текст-заглушка", r"sample description", r"coming soon", r"рыба-текст", r"фыва олдж", r"xxx xxx", r"нет описания", r"без текста", r"описание будет добавлено", r"скоро появится", r"в разработке", r"не публиковать", r"абвгд", r"qwe asd", r"hier steht", r"заполните это поле", r"replace before launch", r"обновите страницу",
]
# Notations of template slots and of technical values in their place.
SLOTS = [
    r"\{\{(?:[^{}\n]|\{(?!\{))*\}", r"\{%(?:(?!\{%|%\}).)*%\}", r"<%(?:(?!<%|%>).)*%>", r"\$\{[^{}\n]+\}", r"\$\([a-z_]\w*\)", r"%\([a-z_]\w*\)[sd]", r"%%[A-Z_]\w*%%", r"%[A-Z][A-Z_]+%", r"@@\w+@@", r"~[a-z_]+~", r"\*\|\w+\|\*", r"#[A-Z][A-Z_]+#", r"__[A-Z][A-Z_]*__",
    r"<<[^<>\n]+>>", r"&lt;[\w ]+&gt;", r"<(?:бренд|название|цена|размер|цвет|имя|укажите[^<>]*|вставьте[^<>]*|name|brand|title|price|size|colou?r|insert[^<>]*|your[^<>]*)>", r"\{[A-Za-zА-Яа-яё]\w*\}", r"\{\d\}", r"\[\[[^\[\]\n]+\]\]", r"\[(?:[A-ZА-ЯЁ]{3,}(?: [A-ZА-ЯЁ]{2,})*|вставить[^\]\n]*|вставьте[^\]\n]*|укажите[^\]\n]*|your [^\]\n]+|insert [^\]\n]+)\]",
    r"вставьте_\w+", r"\[object object\]",
]
# Words a program prints for a missing value.
TECHNICAL = r"(?<![\w«\"'.-])(?:undefined|nan|null)(?![\w»\"'-])(?! is not a)"

_PHRASE = re.compile("|".join(PHRASES), re.I)
_SLOT = re.compile("|".join(SLOTS))
_SLOT_ANY_CASE = re.compile("|".join(s for s in SLOTS if "A-Z" not in s), re.I)
_TECHNICAL = re.compile(TECHNICAL, re.I)
_SPECIAL = re.compile(r"[{}<>\[\]$%@~#*_|&]|\(\(|\)\)|:\w+:|undefined|nan|null|object", re.I)
_PIECE = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORDS = re.compile(r"\w+")
_TITLE = re.compile(r"\s*[^.!?\n]*")
_HEX = re.compile(r"[0-9a-f]{8,}")
_SPAN = re.compile(r"([{(<\[$%@~#*_|&:]+)([^{}()<>\[\]$%@~#*|&\n]*)([})>\]$%@~#*_|&:]+)")
_SIGNS = set("{}<>[]$%@~#*|&():")
_OPENS = dict(zip("{([<", "})]>", strict=True))
# Words that programs and templates print or name; a passage's neighbours of them are features.
_NAMED = {"undefined", "nan", "null", "object", "title", "name", "brand", "цвет", "бренд", "название", "вставить", "your"}


def notation(text: str) -> int:
    """The place in SLOTS of the first notation of an unfilled slot that ``text`` shows, len(SLOTS) for a technical value, -1 for none."""
    if not (_SLOT.search(text) or _SLOT_ANY_CASE.search(text)):
        return len(SLOTS) if _TECHNICAL.search(text) else -1
    return next(i for i, s in enumerate(SLOTS) if re.search(s, text) or ("A-Z" not in s and re.search(s, text, re.I)))


def slot(text: str) -> bool:
    """Whether ``text`` shows the notation of an unfilled slot or of a technical value in its place."""
    return bool(_SLOT.search(text) or _SLOT_ANY_CASE.search(text) or _TECHNICAL.search(text))


class Hashed(dict):
    """32-bit hashes of words; digits count alike, as do long hexadecimal numbers."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        text = "9" if word.isdigit() else "hex" if _HEX.fullmatch(word) else word
        self[word] = value = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))
        return value


def _named(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % DIMS


_LENGTHS, _VARIETIES = ([_named(f"\x01{name} {i}") for i in range(11)] for name in ("length", "variety"))


def document_features(texts: list[str], hashed: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of all ``texts``, in no order.

    Distinct hashed words and word pairs of the whole text (norm 1), its length and variety, and
    the words of its first sentence as title.  Words are hashed once; pairs are hashed as arrays.
    """
    words = [_WORDS.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(hashed.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    pairs = (flat[:-1] * np.uint64(0x9E3779B1) + flat[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    inner = row[:-1] == row[1:]
    kind = np.uint32 if len(texts) < 1 << 16 else np.uint64  # small keys sort faster
    place = row.astype(kind) * kind(DIMS)
    keys = np.sort(np.concatenate([place + (flat % np.uint64(DIMS)).astype(kind), (place[:-1] + (pairs % np.uint64(DIMS)).astype(kind))[inner]]))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])].astype(np.int64) if len(keys) else keys.astype(np.int64)
    at, col = keys // DIMS, keys % DIMS
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(texts))))
    own, where, weight = [], [], []
    for i, (ws, t) in enumerate(zip(words, texts, strict=True)):
        title = {hashed[w] for w in ws[: len(_WORDS.findall(_TITLE.match(t).group()))]}
        own += [i] * (len(title) + 2)
        where += [_LENGTHS[min(10, len(ws).bit_length())], _VARIETIES[10 * len(set(ws)) // max(1, len(ws))], *((h * 31 + 7) % DIMS for h in title)]
        weight += [0.3, 0.3, *[0.5 / math.sqrt(len(title) + 20)] * len(title)]
    return np.concatenate([at, np.array(own, np.int64)]), np.concatenate([col, np.array(where, np.int64)]), np.concatenate([scale[at], np.array(weight)])


def _kind(word: str) -> str:
    if word.isdigit():
        return "9"
    script = "l" if word.isascii() else "c"
    return script + ("_" if "_" in word or "." in word else "") + ("A" if word.isupper() else "a") + ("1" if len(word) == 1 else "")


def _spans(text: str) -> Iterator[str]:
    """What stands between signs, by the form of the signs and of the words, whatever the signs are."""
    for m in _SPAN.finditer(text):
        opens, inner, closes = m.groups()
        mirrored = all(_OPENS.get(a, a) == b for a, b in zip(opens, reversed(closes), strict=False))
        words = _WORDS.findall(inner)
        form = " ".join(dict.fromkeys(_kind(w) for w in words[:6])) or "none"
        tight = int(not inner[:1].isspace()) + int(not inner[-1:].isspace())
        few = min(len(words), 4)
        yield f"\x03between {mirrored} {min(len(opens), 3)} {min(len(closes), 3)} {tight}"
        yield f"\x03form {mirrored} {min(len(opens), 2)} {form} {few}"
        yield f"\x03signs {opens} {closes}"
        yield f"\x03signs {opens} {form}"
        for w in words[:6]:
            yield f"\x03word {w.lower()}"


def passage_features(text: str) -> list[int]:
    """Columns of a passage: runs of up to four signs and shapes of words around special signs, and spans between signs.  All weigh the same."""
    pieces = _PIECE.findall(text)
    shape = [_kind(p) if p[0].isalnum() or p[0] == "_" else p for p in pieces]
    near = {(i, j) for p, x in enumerate(pieces) if x in _SIGNS or "_" in x for i in range(max(0, p - 3), p + 1) for j in range(p + 1, min(len(pieces), i + 4) + 1)}
    grams = {"\x02" + " ".join(shape[i:j]) for i, j in near}
    lower = [p.lower() for p in pieces]
    grams.update("\x02w " + p for p in lower if p in _NAMED)
    grams.update(f"\x02n {a} {b}" for a, b in zip(lower, lower[1:], strict=False) if a in _NAMED)
    grams.update(f"\x02p {a} {b}" for a, b in zip(lower, lower[1:], strict=False) if b in _NAMED)
    grams.update(_spans(text))
    return [_named(g) for g in grams]


def passages(text: str) -> list[str]:
    """The sentences of a text with special characters or technical words."""
    return [s for s in _SENTENCE.split(text) if _SPECIAL.search(s)] if _SPECIAL.search(text) else []


class LinearModel:
    """Ridge logistic regression over hashed features."""

    def __init__(self):
        self.weights = np.zeros(DIMS + 1, np.float64)

    def fit(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, labels: np.ndarray) -> LinearModel:
        """Adam over the full sample; classes weigh the same in sum."""
        y, n = labels.astype(np.float64), len(labels)
        if not 0 < y.sum() < n:
            self.weights[DIMS] = 0.0 if not n else (6.0 if y[0] else -6.0)
            return self
        used, col = np.unique(col, return_inverse=True)
        each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        w, m, v = (np.zeros(len(used) + 1) for _ in range(3))
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-(np.bincount(row, val * w[col], n) + w[-1])))
            error = (p - y) * each
            grad = np.append(np.bincount(col, val * error[row], len(used)) + PENALTY * w[:-1], error.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.weights[used], self.weights[DIMS] = w[:-1], w[-1]
        return self

    def scores(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` rows."""
        z = np.bincount(row, val * self.weights[col], n) + self.weights[DIMS]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _passage_arrays(features: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    col = np.fromiter((c for f in features for c in f), np.int64, int(sizes.sum()))
    return np.repeat(np.arange(len(features)), sizes), col, np.full(len(col), 0.5)


def weak_label(text: str | None) -> int | None:
    """1: message or filler, 0: content, None: unsure or empty."""
    if not text or not text.strip():
        return None
    words = re.findall(r"\w+", text.lower())
    if len(words) >= MONOTONE_WORDS and len(set(words)) <= MONOTONE_PART * len(words):
        return 1
    cover = sum(len(m.group()) for m in _PHRASE.finditer(text)) / len(text)
    return 1 if cover >= COVER else 0 if cover == 0 else None


def _labels(documents: DataFrame) -> DataFrame:
    """(src, kind, label, notation, key, at, val): labelled documents (kind 0) and passages (kind 1), as features in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            known = [(src, text, weak_label(text)) for src, text in zip(batch.column("src").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            judged = [(src, text, label) for src, text, label in known if label is not None]
            row, col, val = document_features([text for _, text, _ in judged], hashed)
            order = np.argsort(row, kind="stable")
            row, col, val = row[order], col[order], val[order]
            edges = np.searchsorted(row, np.arange(len(judged) + 1))
            rows = []
            for i, (src, text, label) in enumerate(judged):
                part = slice(edges[i], edges[i + 1])
                rows.append((src, 0, label, -1, xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")), col[part].astype(np.int32).tobytes(), val[part].astype(np.float32).tobytes()))
            for src, text, _ in known:
                for s in passages(text or ""):
                    at, which = np.array(passage_features(s), np.int32), notation(s)
                    rows.append((src, 1, int(which >= 0), which, xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")), at.tobytes(), np.full(len(at), 0.5, np.float32).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["src", "kind", "label", "notation", "key", "at", "val"])

    return documents.mapInArrow(run, "src string, kind int, label int, notation int, key bigint, at binary, val binary")


def _held_out(src: Column) -> Column:
    return portable_int(F.concat(F.lit("host|"), src)) % HELD_OUT == 0


def _sample(rows: DataFrame, limit: int) -> list:
    """Up to ``limit`` labelled rows of each kind and label, the ones with the smallest hash."""
    out = []
    for kind in (0, 1):
        for label in (0, 1):
            out += rows.where((F.col("kind") == kind) & (F.col("label") == label)).orderBy("key", "at").limit(limit).collect()
    return out


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, val = [np.frombuffer(r.at, np.int32) for r in rows], [np.frombuffer(r.val, np.float32) for r in rows]
    none = [np.zeros(0)]
    return np.repeat(np.arange(len(rows)), [len(a) for a in at]), np.concatenate(at or none).astype(np.int64), np.concatenate(val or none).astype(np.float64)


class ResidueModel:
    """The two fitted classifiers."""

    def __init__(self, rows: list):
        by = [[r for r in rows if r.kind == k] for k in (0, 1)]
        self.document, self.passage = (LinearModel().fit(*_arrays(part), np.array([r.label for r in part])) for part in by)

    def judge(self, texts: list[str | None], hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
        """Message and slot scores of ``texts``; null and blank texts are no case."""
        full = [i for i, t in enumerate(texts) if t and t.strip()]
        message, best = np.zeros(len(texts)), np.zeros(len(texts))
        if full:
            message[full] = self.document.scores(*document_features([texts[i] for i in full], hashed), len(full))
        owner, features = [], []
        for i in full:
            for s in passages(texts[i]):
                owner.append(i)
                features.append(passage_features(s))
        if owner:
            np.maximum.at(best, owner, self.passage.scores(*_passage_arrays(features), len(features)))
        return message, best


def fit(documents: DataFrame, validation: bool = False, limit: int = SAMPLE_ROWS) -> tuple[ResidueModel, list]:
    """The model fitted on a bounded sample, and with ``validation`` a like sample of held-out sources.

    The sample is of the documents with the smallest hashes, about SAMPLE_DOCS; only they are
    labelled.  With ``validation`` the model never sees the held-out sources; without, all sources count.
    """
    part = min(1.0, SAMPLE_DOCS / max(1, documents.count()))
    keyed = documents.select(F.coalesce(source_key("source"), F.lit("")).alias("src"), "text", F.col("doc_id"))
    drawn = keyed.where(portable_int(F.concat_ws("|", F.lit("fit"), F.col("doc_id").cast("string"))) < int(part * 2**32)).select("src", "text")
    table = write_table(_labels(drawn.repartition(documents.sparkSession.sparkContext.defaultParallelism)), "labels")
    rows = table.df
    if validation:
        out = ResidueModel(_sample(rows.where(~_held_out(F.col("src"))), limit)), _sample(rows.where(_held_out(F.col("src"))), limit)
    else:
        out = ResidueModel(_sample(rows, limit)), []
    table.drop()
    return out


def residue_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, message, slot, found) of every document, by the scores of its whole text."""
    model, _ = fit(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            message, best = model.judge(batch.column("text").to_pylist(), hashed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(message), pa.array(best), pa.array((message >= MESSAGE) | (best >= SLOT))], ["doc_id", "message", "slot", "found"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, message double, slot double, found boolean")


def validation_report(documents: DataFrame) -> DataFrame:
    """(kind, rows, positives, precision, recall) of the rule in use, on weak labels of sources unseen in training.

    'notation' is the slot classifier on notations unseen in training: for each notation of
    the list in turn a model is fitted without its passages, and what it finds of them is
    counted; its precision is that on the other sources' passages without a slot.
    """
    model, rows = fit(documents, validation=True)
    out = []
    for kind, name, part, least in ((0, "message", model.document, MESSAGE), (1, "slot", model.passage, SLOT)):
        own = [r for r in rows if r.kind == kind]
        said = part.scores(*_arrays(own), len(own)) >= least if own else np.zeros(0, bool)
        true = np.array([r.label == 1 for r in own], bool)
        hit = int((said & true).sum())
        out.append((name, len(own), int(true.sum()), hit / int(said.sum()) if said.any() else 1.0, hit / int(true.sum()) if true.any() else 1.0))
    slots = [r for r in rows if r.kind == 1]
    hits = said = total = 0
    for which in sorted({r.notation for r in slots if r.notation >= 0}):
        train = [r for i, r in enumerate(slots) if r.notation != which and i % 2 == 0]
        test = [r for i, r in enumerate(slots) if r.notation == which or (r.notation < 0 and i % 2)]
        found = LinearModel().fit(*_arrays(train), np.array([r.label for r in train])).scores(*_arrays(test), len(test)) >= SLOT
        true = np.array([r.notation == which for r in test], bool)
        hits, said, total = hits + int((found & true).sum()), said + int(found.sum()), total + int(true.sum())
    out.append(("notation", len(slots), total, hits / said if said else 1.0, hits / total if total else 1.0))
    return documents.sparkSession.createDataFrame(out, "kind string, rows bigint, positives bigint, precision double, recall double")
