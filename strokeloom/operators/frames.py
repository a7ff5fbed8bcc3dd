"""Per-frame projections and predicates: fingers, gesture, pen point, cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom.functions.scalar import clamp
from strokeloom.params import DRAW, ERASE, INDEX_TIP, JOINTS, PEN_UP, SKELETON, TIPS, WRIST, CaptureRules


def landmark(hand: Column, index: int) -> Column:
    """Null without a hand."""
    return F.get(hand, F.lit(index))


def first_hand(hands: Column) -> Column:
    return F.get(hands, F.lit(0))


def is_right(handedness: Column, fallback: Column | None = None) -> Column:
    """The first name given, else Right."""
    given = F.nullif(handedness, F.lit(""))
    if fallback is not None:
        given = F.coalesce(given, F.nullif(fallback, F.lit("")))
    return F.coalesce(given, F.lit("Right")) == "Right"


def fingers_up(hand: Column, right: Column) -> Column:
    """Five booleans, thumb first: a thumb is out sideways, other tips stand above their joints."""
    pairs = [(landmark(hand, t), landmark(hand, j)) for t, j in zip(TIPS, JOINTS, strict=True)]
    tip, joint = pairs[0]
    thumb = F.when(right, tip["x"] < joint["x"]).otherwise(tip["x"] > joint["x"])
    return F.array(thumb, *(t["y"] < j["y"] for t, j in pairs[1:]))


def gesture(hand: Column, right: Column | None = None) -> Column:
    """Draw: the index finger alone; Erase: all four fingers; else, or without a hand, Pen up."""
    up = fingers_up(hand, F.lit(True) if right is None else right)
    index, rest = F.get(up, F.lit(1)), F.slice(up, 3, 3)
    drawing = index & ~F.exists(rest, lambda x: x)
    erasing = F.forall(F.slice(up, 2, 4), lambda x: x)
    return F.when(hand.isNull(), PEN_UP).when(drawing, DRAW).when(erasing, ERASE).otherwise(PEN_UP)


def display_point(point: Column, w, h) -> Column:
    """struct(x, y): mirrored pixels within the frame."""
    w, h = (F.lit(float(v)) if not isinstance(v, Column) else v.cast("double") for v in (w, h))
    return F.struct(clamp((1 - point["x"]) * w, 0.0, w).alias("x"), clamp(point["y"] * h, 0.0, h).alias("y"))


def normalised(point: Column, w, h) -> Column:
    w, h = (F.lit(float(v)) if not isinstance(v, Column) else v.cast("double") for v in (w, h))
    return F.struct((point["x"] / w).alias("p"), (point["y"] / h).alias("q"))


def pen_frames(frames: DataFrame) -> DataFrame:
    """Frame table to (session_id, us, frame_idx, gesture, down, p, q, x, y, wrist_x, wrist_y)."""
    hand = F.col("landmarks")
    seen = frames.withColumn("gesture", gesture(hand, is_right(F.col("handedness"))))
    tip = display_point(landmark(hand, INDEX_TIP), F.col("frame_w"), F.col("frame_h"))
    wrist = display_point(landmark(hand, WRIST), F.col("frame_w"), F.col("frame_h"))
    seen = seen.withColumns({"down": F.col("gesture") == DRAW, "_tip": tip, "_wrist": wrist})
    unit = normalised(F.col("_tip"), F.col("frame_w"), F.col("frame_h"))
    return seen.select(
        "session_id", F.unix_micros("ts").alias("us"), "frame_idx", "gesture", "down", unit["p"].alias("p"), unit["q"].alias("q"),
        F.col("_tip.x").alias("x"), F.col("_tip.y").alias("y"), F.col("_wrist.x").alias("wrist_x"), F.col("_wrist.y").alias("wrist_y"),
    )


def skeleton_segments(frames: DataFrame, key: str, hand: str = "landmarks") -> DataFrame:
    """One row per edge of the hand's skeleton, looked up in the row: no join, no shuffle."""
    edges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SKELETON))
    lookup = lambda e: F.struct(
        e["a"].alias("a"), e["b"].alias("b"),
        F.get(hand, e["a"])["x"].alias("ax"), F.get(hand, e["a"])["y"].alias("ay"),
        F.get(hand, e["b"])["x"].alias("bx"), F.get(hand, e["b"])["y"].alias("by"),
    )
    return frames.where(F.col(hand).isNotNull()).select(key, F.inline(F.transform(edges, lookup)))


def outside_cooldown(frames: DataFrame, clears: DataFrame, rules: CaptureRules) -> DataFrame:
    """Frames (session_id, us, ...) that no clear (session_id, us) of their session has just preceded.

    An interval anti-join would compare every frame with every clear of its session; the last clear
    at or before a frame decides alone, and a running maximum over both, in order, finds it.
    """
    columns = frames.columns
    marks = clears.select("session_id", "us").withColumn("_clear", F.col("us"))
    rows = frames.withColumn("_clear", F.lit(None).cast("long")).withColumn("_frame", F.lit(True))
    both = rows.unionByName(marks, allowMissingColumns=True)

    # At one instant the clear counts first.
    order = Window.partitionBy("session_id").orderBy("us", F.col("_frame").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("_clear").over(order)
    kept = both.withColumn("_last", last).where(F.col("_frame") & (F.col("_last").isNull() | (F.col("us") - F.col("_last") >= rules.cooldown_us)))
    return kept.select(*columns)


def fenced(rows: DataFrame, current: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    """Rows whose epoch is still their key's current one: results of operations that moved on go."""
    return rows.join(current.select(key, F.col(epoch).alias("_now")), key).where(F.col(epoch) == F.col("_now")).drop("_now")


def live_chunks(chunks: DataFrame, recorders: DataFrame) -> DataFrame:
    """Non-empty chunks of each session's current recorder."""
    return fenced(chunks.where(F.length("data") > 0), recorders, "session_id", "recorder")
