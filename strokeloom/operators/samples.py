"""Sample documents: ordered collection of points, counts, metadata, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import schemas
from strokeloom.functions import scalar as S
from strokeloom.operators.strokes import feature_array
from strokeloom.params import FEATURES, LABELS, CaptureRules, IngestRules


def trajectory_of(points: Column) -> Column:
    """array<struct<p,q,stroke_id>> in order to the trajectory document."""
    return F.struct(
        F.transform(points, lambda x: F.array(x["p"], x["q"])).alias("points_normalized"),
        F.transform(points, lambda x: x["stroke_id"]).alias("stroke_ids"),
        F.coalesce(F.array_max(F.transform(points, lambda x: x["stroke_id"])), F.lit(0)).alias("num_strokes"),
        F.size(points).alias("num_points"),
        feature_array(points).alias("features_8d"),
        F.array(*map(F.lit, FEATURES)).alias("feature_names"),
    ).cast(schemas.TRAJECTORY)


def collect_samples(points: DataFrame, keys: list[str]) -> DataFrame:
    """Long points (keys, idx, p, q, stroke_id) to one row per sample with its trajectory.

    A sample is bounded by the capture rules' cap, so its array is too.
    """
    ordered = F.array_sort(F.collect_list(F.struct("idx", "p", "q", "stroke_id")))
    rows = points.groupBy(*keys).agg(ordered.alias("_points"))
    return rows.withColumn("trajectory", trajectory_of(F.col("_points"))).drop("_points")


def sample_counts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with stroke ids to counts and times; partial sums before the shuffle."""
    down = F.col("down")
    return frames.groupBy(*keys).agg(
        F.count_if(down).alias("num_points"),
        F.coalesce(F.max(F.when(down, F.col("stroke_id"))), F.lit(0)).alias("num_strokes"),
        F.min(F.when(down, F.col("us"))).alias("first_us"),
        F.max(F.when(down, F.col("us"))).alias("last_us"),
        F.coalesce(F.bool_or(down), F.lit(False)).alias("has_ink"),
    )


def media_names(sample_id: Column, image: Column, video: Column, extension: Column, mime: Column) -> Column:
    return F.struct(
        F.when(image.isNotNull(), F.concat(sample_id, F.lit(".png"))).alias("image"),
        F.when(video.isNotNull(), F.concat(sample_id, F.lit("."), extension)).alias("video"),
        F.when(video.isNotNull(), S.blank_to_null(mime)).alias("video_mime"),
    )


def metadata_document(df: DataFrame, rules: IngestRules, capture: CaptureRules) -> DataFrame:
    """df: sample_id, username, label, created_at, auto_saved, media, trajectory, user_agent. Adds `metadata`."""
    document = F.struct(
        F.lit(rules.app).alias("app"),
        F.lit(rules.app_version).alias("app_version"),
        "sample_id",
        S.username_or_default(F.col("username")).alias("username"),
        S.label_in_domain(F.col("label"), LABELS).alias("label"),
        S.iso_text(F.col("created_at")).alias("created_at"),
        "auto_saved",
        F.array(F.lit(capture.frame_w), F.lit(capture.frame_h)).alias("frame_size"),
        "media",
        "trajectory",
        "user_agent",
    )
    return df.withColumn("metadata", document)


def saved_counter(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Saved samples of each session so far."""
    saved = F.when(F.col("reason") != "open", 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("saved", F.sum(saved).over(w))


def join_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (keys, chunk_idx, data) to one binary each, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", "data")))
    whole = F.aggregate(F.col("_chunks"), F.lit(b""), lambda acc, c: F.concat(acc, c["data"]))
    return chunks.groupBy(*keys).agg(ordered.alias("_chunks")).withColumn("data", whole).drop("_chunks")
