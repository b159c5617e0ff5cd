"""Sinks: replace, upsert, append, replace by run; reading JSON with a quarantine; copies of tables.

A table is a folder of Parquet files. What replaces a table is written beside it; then the old one is moved aside, the new one takes its
name, and the old one goes. A crash in between leaves either table whole: `exists` puts the old one back where no new one came.
Checkpoints of a database file have no counterpart: a written folder is what it is.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir; only where that is unset and all runs on one machine, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='snapforge-')}"
    return f"{conf.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    old, _ = _path(spark, f"{path}.old")
    if not fs.exists(p) and fs.exists(old):
        fs.rename(old, p)
    return fs.exists(p)


def _replace(df: DataFrame, path: str) -> None:
    """Writes beside the table, which df may read, then takes its place."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    table, fs = _path(spark, path)
    new, old = _path(spark, f"{path}.next")[0], _path(spark, f"{path}.old")[0]
    if exists(spark, path):
        fs.delete(old, True)
        fs.rename(table, old)
    fs.rename(new, table)
    fs.delete(old, True)


def overwrite(df: DataFrame, path: str, keep_when_empty: bool = True) -> bool:
    """Replaces the table and says whether it did: without any row the table stays as it is, or becomes an empty one if that is asked for."""
    if keep_when_empty and df.isEmpty():
        return False
    _replace(df, path)
    return True


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows with the batch's keys are replaced, others stay; columns are matched by name and missing ones are null."""
    if df.isEmpty():
        return
    if exists(df.sparkSession, path):
        df = df.sparkSession.read.parquet(path).join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df, allowMissingColumns=True)
    _replace(df, path)


def append(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows whose keys the table lacks; null keys never match, and rows of one batch aren't held against each other."""
    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def replace_run(df: DataFrame, path: str, keys: list[str] = ["snapshot_date", "model_run_id"]) -> None:  # noqa: B006
    """Deletes what the batch's dates and runs had, then inserts the batch."""
    upsert(df, path, keys)


def save_predictions(df: DataFrame, path: str, run_id: str, day: str) -> None:
    """(uuid, predicted_eur) of a run for a day; saving them again replaces them."""
    rows = df.select("uuid", F.to_date(F.lit(day)).alias("snapshot_date"), "predicted_eur", F.lit(run_id).alias("model_run_id"), F.current_timestamp().alias("created_at"))
    replace_run(rows, path)


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a file with a record a line: those that don't fit the schema are kept apart as text."""
    return records(spark.read.text(path).where("value <> ''").withColumnRenamed("value", "record"), schema)


def records(rows: DataFrame, schema: str, column: str = "record") -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a column of JSON texts: records as the schema's columns after rows' others, errors as they came."""
    others = [c for c in rows.columns if c != column]
    parsed = rows.withColumn("_r", F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    wrong = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return parsed.where(~wrong).select(*others, *[F.col("_r")[n].alias(n) for n in parsed.schema["_r"].dataType.names if n != "_corrupt"]), parsed.where(wrong).select(*others, column)


def serialised(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema])


def backup(spark: SparkSession, path: str, folder: str, keep: int = 5) -> str:
    """Copies a table's folder under a name with the time, checks that it has as many rows, and keeps the last copies only."""
    source, fs = _path(spark, path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    to = f"{folder.rstrip('/')}/{name}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    target, target_fs = _path(spark, to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, target_fs, target, False, spark._jsc.hadoopConfiguration())
    if spark.read.parquet(to).count() != spark.read.parquet(path).count():
        target_fs.delete(target, True)
        raise OSError(f"copy of {path} isn't whole")
    copies = sorted(s.getPath().toString() for s in target_fs.listStatus(_path(spark, folder)[0]) if s.getPath().getName().startswith(f"{name}-"))
    for old in copies[:-keep]:
        target_fs.delete(_path(spark, old)[0], True)
    return to
