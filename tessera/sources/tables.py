"""Partitioned Parquet tables that are written in part: partitions replaced, rows merged by key and deleted, read back.

A write replaces the partitions that it has rows for and leaves the others alone (dynamic overwrite); the new files are
moved into place when the whole job is done, so a table may be read and rewritten in one go, and a lost executor only
repeats tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. Only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: what several steps start from is computed once, and its size is known."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that was read as it stands, such as a scratch table that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at, fs = _fs(df.sparkSession, folder)
        fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df's partitions; rows are dealt by partition first, so a partition is few files, and split where it is large."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str, by: list[str]) -> None:
    """Upsert: of each key the row of the greatest version stays. by must follow from the keys; only partitions that new
    has rows for are read and rewritten."""
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select(*by).distinct()
        new = new.unionByName(old.join(F.broadcast(touched), by, "left_semi"))
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))
    replace_partitions(new.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n"), path, by)


def delete(spark: SparkSession, path: str, condition: Column, by: list[str]) -> None:
    """Removes the rows for which the condition holds: partitions that keep rows are rewritten, emptied ones removed. A
    condition on partition columns alone reads no file's rows but those of the partitions it names."""
    table = spark.read.parquet(path)
    hit = F.coalesce(condition, F.lit(False))
    counts = table.groupBy(*by).agg(F.count(F.when(hit, 1)).alias("gone"), F.count("*").alias("n")).where("gone > 0")
    state = {tuple(r[:-2]): r["gone"] == r["n"] for r in counts.collect()}  # one row a touched partition
    kept = [k for k, emptied in state.items() if not emptied]
    if kept:
        some = spark.createDataFrame(kept, table.select(*by).schema)
        replace_partitions(table.join(F.broadcast(some), by, "left_semi").where(~hit), path, by)
    for key in (k for k, emptied in state.items() if emptied):
        at, fs = _fs(spark, "/".join([path, *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(by, key))]))
        fs.delete(at, True)
