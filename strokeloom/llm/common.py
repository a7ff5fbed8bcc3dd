"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom.shared import file_system, new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_CLASS = r"\x20\x09-\x0D"
ASCII_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots or backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    The result has no lineage beyond its files, so a lost executor costs no recomputation. The
    folder goes at the end of the scratch it was made in, or else when the driver's JVM ends.
    """
    path = new_folder(df.sparkSession, name)
    if SCRATCH:
        SCRATCH[-1].append(path)
    return _written(df, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """materialize, but the folder outlives the innermost scratch."""
    path = new_folder(df.sparkSession, name)
    if len(SCRATCH) > 1:
        SCRATCH[-2].append(path)
    return _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of the steps under way, innermost last.
SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end; a result must leave by way of kept()."""
    SCRATCH.append([])
    try:
        yield
    finally:
        for path in SCRATCH.pop():
            fs, at = file_system(spark, path)
            fs.delete(at, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Gives up the shuffle files of steps that are over: Spark deletes those that no plan refers to
    once the driver's JVM has collected its garbage."""
    spark.sparkContext._jvm.System.gc()


HOT_SHARE = 1000  # a key with over 1 / HOT_SHARE of all rows, and over HOT_ROWS of them, is hot
HOT_ROWS = 4096


def joined(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """rows with what table, which was written, says of their key (a column or several); table has a
    key once, and in weight how many of the rows have it.

    Hot keys, of which there can't be more than HOT_SHARE, are broadcast; only the others are
    shuffled, so that no task gets more than HOT_ROWS or its share of the rows by one key.
    """
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    plain = table.drop(weight)
    if (most or 0) <= least:
        return rows.join(plain, key)
    hot = F.broadcast(table.where(F.col(weight) > least).drop(weight))
    keys = [key] if isinstance(key, str) else key
    cold = rows.join(hot.select(*keys), key, "left_anti").join(table.where(F.col(weight) <= least).drop(weight), key)
    return rows.join(hot, key).unionByName(cold)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside moves at most `rows` rows at a time to Python; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and no other letter. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def ascii_words(text: Column) -> Column:
    """Words of [0-9A-Za-z] and every non-ASCII character, A-Z lower-cased; null: no words."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), ASCII_BREAK)
    return F.array_remove(parts, "")


def count_words(text: Column) -> Column:
    """Number of runs of anything but space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, in at least as many partitions as there are cores.

    Large tables have more and are not moved. A small file with one row group would otherwise be a
    single task; asking a plain scan for its partitions runs nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
