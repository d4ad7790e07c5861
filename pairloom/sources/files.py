"""Sinks and driver-side files: CSV, audits, hashes, named arguments, packages."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet, all or nothing: the commit protocol renames finished task output."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` moves all rows into one task, for small results only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(value: object, path: str) -> None:
    """Sorted JSON, replaced atomically."""
    scratch = f"{path}.tmp"
    Path(scratch).write_text(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    os.replace(scratch, path)


def read_json(path: str) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def resolve(name: str, *folders: str) -> str:
    """An absolute path as it is; else the first folder that has ``name``; else a place in the last folder."""
    if os.path.isabs(name):
        return name
    for folder in folders:
        if os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    return os.path.join(folders[-1], name) if folders else name


def named(values: list[str], kind: type = str) -> dict:
    """NAME=VALUE arguments; names must be identifiers and occur once."""
    out: dict = {}
    for value in values:
        name, sign, rest = value.partition("=")
        if not sign or not rest or not _NAME.fullmatch(name):
            raise ValueError(f"expected NAME=VALUE, got {value!r}")
        if name in out:
            raise ValueError(f"{name} is given twice")
        out[name] = kind(rest)
    return out


def package(files: dict[str, str], target: str, required: list[str], forbidden: list[str], limit: int = 5 << 30) -> None:
    """A zip of ``files`` (name in the archive -> path), checked: ASCII names, required members, no forbidden text, size, CRC."""
    if missing := [r for r in required if r not in files]:
        raise ValueError(f"missing: {missing}")
    for name, path in files.items():
        if not name.isascii():
            raise ValueError(f"name is not ASCII: {name!r}")
        if name.endswith((".py", ".sh", ".json", ".txt", ".md")):
            text = Path(path).read_text(encoding="utf-8", errors="replace")
            if hit := next((f for f in forbidden if re.search(f, text)), None):
                raise ValueError(f"{name} holds {hit!r}")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in sorted(files.items()):
            z.write(path, name)
    with zipfile.ZipFile(target) as z:
        if bad := z.testzip():
            raise ValueError(f"broken member: {bad}")
    if os.path.getsize(target) > limit:
        raise ValueError("package is too large")


def split_write(df: DataFrame, accepted: str, path: str) -> dict[str, int]:
    """Accepted and other rows as two tables; both are read back and compared with the input by count and content.

    The content is the sum of a 64-bit hash of every row, so order and partitioning don't matter.
    """
    spark = df.sparkSession
    chosen = F.coalesce(F.expr(accepted), F.lit(False))
    write_parquet(df.where(chosen), f"{path}/accepted")
    write_parquet(df.where(~chosen), f"{path}/adjudication")
    digest = F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("digest")
    of = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), digest).head()
    back = {k: of(spark.read.parquet(f"{path}/{k}")) for k in ("accepted", "adjudication")}
    want = {k: of(df.where(c)) for k, c in (("accepted", chosen), ("adjudication", ~chosen))}
    if wrong := [k for k in back if back[k] != want[k]]:
        raise RuntimeError(f"read back of {wrong}: {back}, input has {want}")
    return {k: r.n for k, r in back.items()}
