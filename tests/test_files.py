import hashlib

import pytest

from pairloom.sources import files
from pairloom.streaming.scoring import stream_pairs
from pairloom.workspace import cut, shared_dir, write_table


def test_named_arguments():
    assert files.named(["a=1", "b=2.5"], float) == {"a": 1.0, "b": 2.5}
    for bad in (["a"], ["a="], ["1a=2"], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            files.named(bad)


def test_json_and_hash(tmp_path, spark):
    files.write_json({"b": 1, "a": [2]}, str(tmp_path / "x.json"))
    assert files.read_json(str(tmp_path / "x.json")) == {"a": [2], "b": 1}
    want = hashlib.sha256((tmp_path / "x.json").read_bytes()).hexdigest()
    assert files.sha256_file(str(tmp_path / "x.json")) == want
    assert files.sha256_files(spark, str(tmp_path / "*.json")).head().sha256 == want


def test_resolve(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x").write_text("")
    assert files.resolve("x", str(tmp_path / "in"), str(tmp_path / "out")) == str(tmp_path / "in/x")
    assert files.resolve("y", str(tmp_path / "in"), str(tmp_path / "out")) == str(tmp_path / "out/y")
    assert files.resolve("/abs/y", "z") == "/abs/y"


def test_package(tmp_path):
    (tmp_path / "run.py").write_text("print(1)")
    files.package({"run.py": str(tmp_path / "run.py")}, str(tmp_path / "o.zip"), ["run.py"], ["secret"])
    with pytest.raises(ValueError):
        files.package({"run.py": str(tmp_path / "run.py")}, str(tmp_path / "o.zip"), ["x"], [])
    with pytest.raises(ValueError):
        files.package({"run.py": str(tmp_path / "run.py")}, str(tmp_path / "o.zip"), [], ["print"])
    with pytest.raises(ValueError):
        files.package({"é.py": str(tmp_path / "run.py")}, str(tmp_path / "o.zip"), [], [])


def test_sinks(tmp_path, spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    assert files.split_write(df, "ok", str(tmp_path / "s")) == {"accepted": 1, "adjudication": 2}
    files.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "ok"]


def test_tables_of_an_application_can_be_cleared(spark):
    import os

    from pairloom import workspace

    t = write_table(spark.range(3))
    folder = workspace.own_dir(spark)
    assert t.path.startswith(folder) and os.path.isdir(folder.removeprefix("file://"))
    workspace.clear(spark)
    assert not os.path.exists(folder.removeprefix("file://")) and cut(spark.range(2)).count() == 2


def test_workspace(spark):
    df = spark.range(10)
    assert cut(df).count() == 10
    t = write_table(df)
    assert t.path.startswith(shared_dir(spark))
    t.drop()


def test_stream(tmp_path, spark):
    spark.range(20).selectExpr("id as id1", "id + 1 as id2").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id1 bigint, id2 bigint").parquet(str(tmp_path / "in"))
    stream_pairs(source, lambda b: b.where("id1 % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
