"""Reading and keeping rows: uploads as text, upserts, deletes with a trash, snapshots."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRASH_DAYS = 30


def read_upload(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, text) of uploaded files of kind txt, md, json or csv, one row a file."""
    if kind not in ("txt", "md", "json", "csv"):
        raise ValueError(f"no reader for {kind}")
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", {"json": flatten_json, "csv": csv_text}.get(kind, lambda c: c)(F.col("text")))


def _flat(value, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(value, dict):
        parts = []
        for key, item in value.items():
            inner = _flat(item, depth + 1)
            if inner.strip():
                parts.append(f"{pad}{key}:\n{inner}" if isinstance(item, (dict, list)) else f"{pad}{key}: {inner.strip()}")
        return "\n".join(parts)
    if isinstance(value, list):
        return "\n".join(x for x in (_flat(item, depth) for item in value) if x.strip())
    if value is None:
        return ""
    return pad + (value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def flatten_json(text: Column) -> Column:
    """Nested JSON as indented "key: value" lines; empty parts go; text that isn't JSON stays."""

    @F.pandas_udf(StringType())
    def flat(texts: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return _flat(json.loads(raw)) if raw is not None else None
            except ValueError:
                return raw

        return texts.map(one)

    return flat(text)


def csv_text(text: Column) -> Column:
    """CSV as paragraphs of "header: value" lines. Commas part fields, quotes mean nothing; blank fields are left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.split(F.element_at(lines, 1), ",")

    def record(line: Column) -> Column:
        pairs = F.zip_with(head, F.split(line, ","), lambda h, v: F.when(F.trim(v) != "", F.concat(F.trim(h), F.lit(": "), F.trim(v))))
        return F.array_join(F.array_compact(pairs), "\n")

    return F.array_join(F.transform(F.slice(lines, 2, 2147483646), record), "\n\n")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old that new has no key of, and all of new; the last of new's rows with one key must be chosen before."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete(rows: DataFrame, gone: DataFrame, now: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, trash): the trash holds each deleted row as JSON, with the time after which it is purged."""
    ids = gone.select(key).distinct()
    trash = rows.join(ids, key, "left_semi").select(
        key, F.to_json(F.struct(*rows.columns)).alias("row"), F.lit(now).alias("deleted_at"), F.lit(now + TRASH_DAYS * 86400).alias("expires_at")
    )
    return rows.join(ids, key, "left_anti").select(rows.columns), trash


def restore(rows: DataFrame, trash: DataFrame, ids: list, now: int, key: str = "id") -> DataFrame:
    """rows and the trashed rows of those ids that haven't expired."""
    back = trash.where(F.col(key).isin(ids) & (F.col("expires_at") > now)).select(F.from_json("row", rows.schema).alias("r")).select("r.*")
    return rows.unionByName(back)


def snapshot(rows: DataFrame, folder: str, version: int) -> str:
    """Write a version of a table; readers name the version, so none sees a half-written one."""
    path = f"{folder}/version={version:012d}"
    rows.write.mode("overwrite").parquet(path)
    return path


def latest(history: DataFrame, keep: int, *key: str, order: str = "ts") -> DataFrame:
    """The newest rows of each key, at most keep."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return history.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


# Words around the address in lines of the login log.
_LOGIN_FAILURES = ["Failed password", "Invalid user", "authentication failure"]


def web_log(line: Column) -> Column:
    """ip, path and status of a line of the web server's log; null if it is none."""
    pattern = r'^(\S+) .*?"[A-Z]+ (\S+)[^"]*" (\d{3})\b'
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("ip"), part(2).alias("path"), part(3).cast("int").alias("status")))


def login_failure(line: Column) -> Column:
    """Address of a failed login that doesn't come from a private network; null if the line is none."""
    failed = F.lit(False)
    for words in _LOGIN_FAILURES:
        failed = failed | F.contains(line, F.lit(words))
    ip = F.regexp_extract(line, r"^.* from (\d+\.\d+\.\d+\.\d+)", 1)
    return F.when(failed & (ip != "") & ~private(ip), ip)


def private(ip: Column) -> Column:
    """Loopback, private, link-local, multicast and broadcast addresses of version 4."""
    return ip.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|22[4-9]\.|23\d\.|255\.255\.255\.255$)")
