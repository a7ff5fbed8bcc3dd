"""Readers: engine tables, JSON requests, and the driver's tables seen as frames and points."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom import schemas
from strokeloom.functions import scalar as S
from strokeloom.params import LABELS, IngestRules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A frame table, or its files as they come."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.FRAMES).parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON requests, a line each; the line itself stays in `body`."""
    return parse_requests(spark.read.text(path).withColumnRenamed("value", "body"))


def settled(df: DataFrame) -> DataFrame:
    """df behind a one-row generator, below which no filter is pushed: columns that many others are
    made of are computed once, and not once for each use in a predicate."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_requests(bodies: DataFrame, max_body: int | None = None) -> DataFrame:
    """bodies: (body, ...). Adds `request` and `body_status`: 413 over max_body bytes, 400 if the
    body is not one JSON object and nothing else, else null. An empty body is an empty object.

    Fields of the wrong type count as absent; no body stops a job.
    """
    text = F.coalesce(S.blank_to_null(F.col("body")), F.lit("{}"))
    # As the one item of an array: text after the object would make two of it, or none.
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    whole = (F.size(items) == 1) & F.startswith(F.ltrim(text), F.lit("{"))
    parsed = F.from_json(text, schemas.REQUEST, {"mode": "PERMISSIVE", **STRICT})
    rows = settled(bodies.withColumns({"request": parsed, "_whole": F.coalesce(whole, F.lit(False))}))
    too_long = F.octet_length("body") > F.lit(max_body) if max_body is not None else F.lit(False)
    status = F.when(too_long, F.lit(413)).when(~F.col("_whole"), F.lit(400))
    return rows.withColumn("body_status", status).drop("_whole")


def dealt(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small table of one file is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settings(df: DataFrame, username: str = "username", label: str = "label", key: str = "upload_key", default_user: str = "user1") -> DataFrame:
    """Saved settings with their defaults."""
    return df.withColumns({
        username: S.first_given(F.col(username), F.lit(default_user)),
        label: S.label_in_domain(F.col(label), LABELS),
        key: F.coalesce(key, F.lit("")),
    })


def checked_rules(repo: str, token: str | None = None, **given) -> IngestRules:
    """IngestRules; repo must be owner/name without white space, and a token must be there."""
    if not token:
        raise ValueError("a token for the store is needed")
    if not re.fullmatch(r"[^/\s]+/[^/\s]+", repo or ""):
        raise ValueError("repo must be owner/name")
    chosen = {k: v for k, v in given.items() if v not in (None, "")}
    rules = IngestRules(repo=repo, **chosen)
    return IngestRules(**{**vars(rules), "output_dir": rules.output_dir.strip("/")})


# The driver's tables as input of the engine.


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a frame each; (session_id, us, event_id) is its place, gesture and normal point its content."""
    kind = F.col("event_type")
    gesture = F.when(kind.isin("click", "view", "purchase"), "Draw").when(kind == "signup", "Erase").otherwise("Pen up")
    q = F.get_json_object("props", "$.k").cast("int") / 100
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_id",
        gesture.alias("gesture"),
        (gesture == "Draw").alias("down"),
        S.clamp(F.col("value") / 500, 0.0, 1.0).alias("p"),
        q.alias("q"),
    )


def event_controls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frames, controls) of the events: errors are controls by their id, but for one in five, which
    stays a frame without pen."""
    frames = event_frames(spark, sf_dir).withColumn("seq", F.col("event_id"))
    kind = F.element_at(F.array(*map(F.lit, ("clear", "save", "save_failed", "save_ok"))), F.least(F.col("event_id") % 5, F.lit(3)).cast("int") + 1)
    error = (F.col("gesture") == "Pen up") & (F.col("event_id") % 5 < 4)
    return frames.where(~error), frames.where(error).select("session_id", "us", "seq", kind.alias("action"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def embedding_points(spark: SparkSession, sf_dir: str, strokes: int = 2) -> DataFrame:
    """embeddings: a sample of 32 points each, (vec_id, points), in strokes of equal length."""
    point = lambda i: F.struct(
        F.element_at("v", 2 * i + 1).alias("p"), F.element_at("v", 2 * i + 2).alias("q"),
        (F.floor(i * strokes / (F.size("v") / 2)) + 1).cast("int").alias("stroke_id"),
    )
    last = (F.size("v") / 2).cast("int") - 1
    return _numbers(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), last), point).alias("points"))


def embedding_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: one hand each, (vec_id, landmarks, handedness); the 42 first numbers are 21 points."""
    point = lambda i: F.struct(F.element_at("v", 2 * i + 1).alias("x"), F.element_at("v", 2 * i + 2).alias("y"))
    hand = F.when(F.col("vec_id") % 3 == 0, F.lit("Left")).when(F.col("vec_id") % 3 == 1, F.lit("Right"))
    return _numbers(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), point).alias("landmarks"), hand.alias("handedness"))


