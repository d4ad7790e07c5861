import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T

CASES = [
    ('{"Бренд":"нет","цвет":"x"}', "бренд=нет; цвет=x", "цвет=x; бренд=нет"),
    ('{" Тип ":"a","тип":"b"}', None, "тип=b"),
    ("[1,2]", None, ""),
    ("bad", None, ""),
    (None, None, ""),
    ("{}", None, ""),
    ('{"k":null}', None, "k=None"),
    ('{"k":2.50,"n":7}', None, "k=2.5; n=7"),
    ('{"k":""}', None, ""),
    (json.dumps({"k": "v" * 80}), None, "k=" + "v" * 60),
]


@pytest.mark.parametrize(("attributes", "_", "expected"), CASES)
def test_card_text(spark, attributes, _, expected):
    df = spark.createDataFrame([("n", "c", attributes)], "name string, category string, attributes string")
    assert T.with_entries(df).select(T.card_text(F.col("name"), F.col("category"), F.col("entries"), 350)).head()[0] == f"c | n | {expected}"


def test_card_text_cuts_the_joined_text(spark):
    df = spark.createDataFrame([(None, None, '{"a":"1","b":"2"}')], "name string, category string, attributes string")
    assert T.with_entries(df).select(T.card_text(F.col("name"), F.col("category"), F.col("entries"), 6)).head()[0] == "None | None | a=1; b"


def test_cap_counts_code_points(spark):
    df = spark.createDataFrame([("n", "c", '{"a":"😀😀😀"}')], "name string, category string, attributes string")
    assert T.with_entries(df).select(T.card_text(F.col("name"), F.col("category"), F.col("entries"), 4)).head()[0] == "c | n | a=😀😀"


@pytest.mark.parametrize("row", [(" A  B", "{}", "C"), ("İ", "x\x1cy", "c"), ("ΑΣ", None, None), (None, " z ", "Ж"), ("", "", "")])
def test_fingerprint_is_that_of_the_plain_formula(spark, row):
    name, attributes, category = row
    plain = re.sub(r"\s+", " ", f"{str(name).lower().strip()}|{str(attributes).lower().strip()}|{category}")
    df = spark.createDataFrame([row], "n string, a string, c string")
    assert df.select(T.fingerprint(F.col("n"), F.col("a"), F.col("c"))).head()[0] == hashlib.md5(plain.encode()).hexdigest()


def test_prompt_card(spark):
    df = spark.createDataFrame([("n", '{"гарантийный срок":"1","цвет":"x","артикул":"A","z":" "}')], "n string, a string")
    assert T.with_entries(df, attributes="a", normalised=False).select(T.prompt_card(F.col("n"), F.col("entries"))).head()[0] == "Название: n\nАтрибуты: артикул: A; цвет: x"


def test_jaccard(spark):
    df = spark.createDataFrame([("Чай ЧАЙ black", "чай"), (None, "x"), ("", "")], "a string, b string")
    got = df.select(T.set_jaccard(T.name_tokens(F.col("a")), T.name_tokens(F.col("b")), -1.0)).collect()
    assert [r[0] for r in got] == [0.5, -1.0, -1.0]
