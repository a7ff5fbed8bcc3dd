"""Two-pass external shuffle of whole records into shards of equal counts.

Pass one scatters the records, texts and all, by a seeded hash into buckets that fit in memory: their
number follows from the bytes the records really have. Pass two shuffles every bucket with
Fisher-Yates, gives its records the places that follow those of the buckets before it, and writes
them. All records together then stand in one random order; shards are equal slices of it (law
`rows`: counts at most one apart), a folder each, in which a record has its slot.

A record's hash is of its number in the input, so that copies scatter like all other records. The
number is fixed as long as a lost task reads the same input again: docs should come from files, as
they do here, and not from an unsorted shuffle.

Defined cases: a null text counts no bytes and has checksum 0; rows that repeat stay rows, each with
a place of its own; an empty table gives no rows; fewer rows than shards leave the last shards
empty; a long text makes its bucket larger by itself and no other; extra columns ride along and may
bear any name; those named `shard` or `slot` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import documents, quoted
from strokeloom.shared import new_folder

SHARDS = 8
SEED = 7919
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 65_536
MAX_BROADCAST_BUCKETS = 1 << 18  # rows of two numbers; with more of them the places are joined by a shuffle


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): from the end, swap each place with one at or before it."""
    order = np.arange(n)
    picks = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else order
    for last, pick in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
        order[last], order[pick] = order[pick], order[last]
    return order


def placed_records(
    docs: DataFrame, text: str = "text", n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """docs with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard)."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    # A record travels as one struct, so that its columns may bear any names.
    numbered = docs.select(F.struct(*quoted(columns)).alias("_srow"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("_skey"))
    size = F.coalesce(F.octet_length(F.col("_srow").getField(text)), F.lit(0)).cast("long") + 1
    total = numbered.agg(F.count(F.lit(1)), F.sum(size)).first()
    rows, held = total[0], total[1] or 0
    buckets = max(1, -(-held // bucket_bytes), -(-rows // bucket_rows))
    scattered = numbered.withColumn("_sbucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_skey"), F.lit(buckets)))
    upto = Window.orderBy("_sbucket").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        scattered.groupBy("_sbucket").agg(F.count(F.lit(1)).alias("_sn"))
        .select(F.col("_sbucket").alias("_sb"), F.coalesce(F.sum("_sn").over(upto), F.lit(0)).cast("long").alias("_sfirst"))
    )
    places = F.broadcast(places) if buckets <= MAX_BROADCAST_BUCKETS else places
    joined = scattered.join(places, F.col("_sbucket") == F.col("_sb")).drop("_sb")
    schema = joined.drop("_skey", "_sbucket", "_sfirst").withColumn("_splace", F.lit(0).cast("long")).schema

    def shuffled(key: tuple, bucket: pa.Table) -> pa.Table:
        # Arrow, not pandas: there, whole numbers beside nulls would turn into floats.
        order = np.argsort(bucket["_skey"].to_numpy())
        order = order[fisher_yates(len(order), (seed << 20) + key[0].as_py())]
        place = bucket["_sfirst"][0].as_py() + np.arange(len(order))
        return bucket.select(["_srow"]).take(pa.array(order)).append_column("_splace", pa.array(place))

    out = joined.groupBy("_sbucket").applyInArrow(shuffled, schema)
    n = max(rows, 1)
    first = F.expr(f"(_sshard * {n}L + {n_shards - 1}L) div {n_shards}L")  # the shard's first place
    sliced = out.withColumn("_sshard", F.expr(f"(_splace * {n_shards}L) div {n}L"))
    own = [F.col("_srow").getField(c).alias(c) for c in columns]
    return sliced.select(*own, F.col("_sshard").cast("int").alias("shard"), (F.col("_splace") - first).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """Writes placed_records, one folder per shard, and reads them back. Buckets are written as they
    stand: a bucket's records have neighbouring places, so each file holds few shards."""
    placed.write.partitionBy("shard").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_records(documents(spark, sf_dir).select("doc_id", "text"))
    written = write_shards(placed, new_folder(spark, "shards"))
    text = F.col("text")
    return written.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
