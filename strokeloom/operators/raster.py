"""Ink as an ordered log of operations, and which cells of a grid hold ink in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom.params import CaptureRules


def ink_log(frames: DataFrame, keys: list[str], order: list[str], rules: CaptureRules) -> DataFrame:
    """frames: keys, order, gesture, x, y in pixels (of the pen; of the wrist for Erase).

    Rows of keys, order, kind, the ends of the drawn capsule and its radius. A segment starts at the
    frame before if that drew, too.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    drew = F.lag("gesture").over(w) == "Draw"
    before = {c: F.when((F.col("gesture") == "Draw") & drew, F.lag(c[1:]).over(w)).otherwise(F.col(c[1:])) for c in ("_x", "_y")}
    radius = F.when(F.col("gesture") == "Draw", rules.brush).otherwise(rules.eraser)
    rows = frames.withColumns({"x0": before["_x"], "y0": before["_y"]}).where(F.col("gesture").isin("Draw", "Erase"))
    return rows.select(*keys, *order, F.col("gesture").alias("kind"), "x0", "y0", F.col("x").alias("x1"), F.col("y").alias("y1"), radius.alias("radius"))


def covers(cx: Column, cy: Column) -> Column:
    """Whether the capsule of a log row covers a place."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = dx * dx + dy * dy
    along = F.when(size == 0, F.lit(0.0)).otherwise(((cx - F.col("x0")) * dx + (cy - F.col("y0")) * dy) / size)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = F.col("x0") + t * dx - cx, F.col("y0") + t * dy - cy
    return ex * ex + ey * ey <= F.col("radius") * F.col("radius")


def occupancy(log: DataFrame, keys: list[str], order: list[str], cell: int, rules: CaptureRules) -> DataFrame:
    """(keys, cx, cy) of the cells whose centre was last covered by ink, not by an erasure.

    Only cells in a row's bounding box are made; each cell's last operation comes from partial
    maxima before the shuffle.
    """
    wide, high = -(-rules.frame_w // cell), -(-rules.frame_h // cell)

    def span(a: str, b: str, most: int) -> Column:
        low = F.greatest(F.lit(0), F.floor((F.least(a, b) - F.col("radius")) / cell))
        return F.sequence(low.cast("int"), F.greatest(low, F.least(F.lit(most - 1), F.floor((F.greatest(a, b) + F.col("radius")) / cell))).cast("int"))

    cells = log.withColumn("cx", F.explode(span("x0", "x1", wide))).withColumn("cy", F.explode(span("y0", "y1", high)))
    hit = cells.where((F.col("cx") < wide) & (F.col("cy") < high)).where(covers((F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell))
    last = hit.groupBy(*keys, "cx", "cy").agg(F.max_by("kind", F.struct(*order)).alias("kind"))
    return last.where("kind = 'Draw'").select(*keys, "cx", "cy")
