"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

1. One aggregate gives every source its size in words. Targets are shared by weight and stop at
   twice a source's size; the excess is reshared by weight: the water level over the sources
   ordered by cap / weight.
2. A source's documents stand in seeded hash order on a line as long as the source. A target over
   that length runs along the line a second time. The running offsets come from two levels: sums
   of hash buckets of bounded expected rows, then running sums inside a bucket, so that a source
   with a third of all rows is many tasks.
3. Each source's weight changes linearly over training, w(t) = 1 + slope (1 - 2t) for t in [0, 1].
   Its integral is the share of the source's demand met by time t; inverting it at a document's
   offset gives the document's training position.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source, the
last in order; a table without words has targets of 0; an empty table gives no rows; a very long
text is one document, which a target may cut; rows that repeat are documents of their own, numbered
and spread over their source like others (which of them has which number is open: they are alike);
on equal hashes the lesser id stands first. Extra columns are not read and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import count_words, documents, materialize, quoted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
ROWS_PER_BUCKET = 4096
SLOPES = (0.5, 0.0, -0.5)  # heavy sources early, light ones late
SEED = 20240607


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds weight, slope, target.

    A source is full if the level at its own cap / weight would need no more than all words asked
    for; the level is what is left over by the weights of those that are not full.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # Spark compares UTF-8 bytes: code points
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_mi") + 1)
    named = sizes.withColumn("_mi", (F.row_number().over(order) - 1) % len(weights)).select(
        "source", "source_size", cycle([float(w) for w in weights]).alias("weight"), cycle(SLOPES).alias("slope")
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_mratio", F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        named.withColumn("_mratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("_mfull", F.coalesce(F.sum(cap * F.col("source_size")).over(upto), F.lit(0.0)))
        .withColumn("_mrest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_mall", share * F.sum("source_size").over(everything))
        .withColumn("_mlevel", (F.col("_mall") - F.col("_mfull")) / F.col("_mrest"))
        .withColumn("_mrank", F.row_number().over(by_ratio))
    )
    fits = F.when(F.col("_mlevel") <= F.col("_mratio"), F.struct("_mrank", "_mlevel"))
    level = level.withColumn("_mlevel", F.min(fits).over(everything)["_mlevel"])
    full = cap * F.col("source_size")
    target = F.least(full, F.coalesce(F.col("weight") * F.col("_mlevel"), full))
    return level.select("source", "source_size", "weight", "slope", target.cast("double").alias("target"))


def demand_time(share: Column, slope: Column) -> Column:
    """Time by which a source has met `share` of its demand: the inverse of (1 + s) t - s t^2."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * share))
    return F.when(slope == 0, share).otherwise((1 + slope - root) / (2 * slope))


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), seed: int = SEED,
    weights=WEIGHTS, share: float = SHARE, cap: float = CAP, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first and second
    (words taken in either run along the source), position and position_again (the place in training,
    in [0, 1], of either; null if the run takes nothing), and the columns in carry, which should be
    small: texts are not moved."""
    column = lambda c: quoted([c])[0]
    digest = docs.select(
        column(doc_id).alias("doc_id"), column(source).alias("source"), count_words(column(text)).alias("size"),
        F.xxhash64(F.lit(seed), column(doc_id), column(text)).alias("_mhash"), *(column(c).alias(f"_mc_{c}") for c in carry),
    )
    # Rows alike get numbers, from a partial count, so that copies spread over their source like others.
    counted = digest.groupBy(*digest.columns).agg(F.count(F.lit(1)).alias("_mn"))
    each = counted.withColumn("_mcopy", F.explode(F.sequence(F.lit(1).cast("long"), "_mn"))).drop("_mn")
    each = materialize(each.withColumn("_mkey", F.xxhash64(F.lit(seed), "_mhash", "_mcopy")), "mixing")
    per_source = materialize(each.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mn")), "sources")
    aims = targets(per_source.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "_ms")
    aims = aims.join(
        per_source.select(F.col("source").alias("_ms2"), F.ceil(F.col("_mn") / rows_per_bucket).alias("_mbuckets")),
        F.col("_ms").eqNullSafe(F.col("_ms2")),
    ).drop("_ms2")
    # Hash order inside a source: the bucket is the leading part of the order key.
    unit = (F.shiftrightunsigned("_mkey", 11).cast("double")) / float(1 << 53)
    aims = F.broadcast(aims) if _small(per_source) else aims
    placed = each.join(aims, F.col("source").eqNullSafe(F.col("_ms"))).drop("_ms").withColumn("_mb", F.floor(unit * F.col("_mbuckets")))
    key = ["source", "_mb"]
    sums = placed.groupBy(*key).agg(F.sum("size").alias("_msum"))
    before = F.sum("_msum").over(Window.partitionBy("source").orderBy("_mb").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(
        F.col("source").alias("_ms"), F.col("_mb").alias("_mb2"), F.coalesce(before, F.lit(0)).alias("_mstart")
    )
    # Unsigned order, as in the buckets.
    inside = Window.partitionBy(*key).orderBy(F.shiftrightunsigned("_mkey", 1), "_mkey", "_mhash", "doc_id", "size")
    inner = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    lined = placed.withColumn("_minner", inner).join(
        offsets, F.col("source").eqNullSafe(F.col("_ms")) & (F.col("_mb") == F.col("_mb2"))
    )
    at = F.col("_minner") + F.col("_mstart")
    aim = F.floor("target")
    clip = lambda left: F.greatest(F.lit(0), F.least(F.col("size"), left))
    done = lined.withColumn("first", clip(aim - at)).withColumn("second", clip(aim - F.col("source_size") - at))
    time = lambda run, place: F.when(F.col(run) > 0, demand_time(F.least(F.lit(1.0), place / F.col("target")), F.col("slope")))
    return done.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("first") + F.col("second")).cast("long").alias("taken"),
        F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"),
        time("first", at).alias("position"), time("second", at + F.col("source_size")).alias("position_again"),
        *(F.col(f"_mc_{c}").alias(c) for c in carry),
    )


MAX_BROADCAST_BYTES = 8 << 20  # of the sources' rows, names included


def _small(per_source: DataFrame) -> bool:
    held = per_source.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 128)).first()[0] or 0
    return held <= MAX_BROADCAST_BYTES


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of training; those that the mix never takes come first, without a position."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    mixed = mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "first", "second", "position_again")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
