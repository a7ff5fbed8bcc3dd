"""Stroke ids and trajectory features, as windows over a sample's points and as array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strokeloom.functions.scalar import let, round6
from strokeloom.params import FEATURES

EPSILON = 1e-9


def with_stroke_ids(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds stroke_id: the running count of frames that are down after one that isn't."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rising = F.when(F.col("down") & ~F.coalesce(F.lag("down").over(w), F.lit(False)), 1).otherwise(0)
    flagged = frames.withColumn("_rise", rising)
    return flagged.withColumn("stroke_id", F.sum("_rise").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_rise")


def _direction(dp: Column, dq: Column) -> tuple[Column, Column]:
    """(cosine, sine) of a step; the small term keeps a step of no length at 0, 0."""
    length = F.sqrt(dp * dp + dq * dq) + EPSILON
    return dp / length, dq / length


def features_over(points: DataFrame, w: WindowSpec) -> DataFrame:
    """Adds the eight features to rows with p, q and stroke_id. Nothing restarts at a stroke."""
    p, q = F.col("p"), F.col("q")
    back = lambda c, n: F.lag(c, n).over(w)
    steps = points.withColumns({"_p1": back("p", 1), "_q1": back("q", 1), "_p2": back("p", 2), "_q2": back("q", 2)})
    dp, dq = p - F.col("_p1"), q - F.col("_q1")
    c1, s1 = _direction(dp, dq)
    c2, s2 = _direction(F.col("_p1") - F.col("_p2"), F.col("_q1") - F.col("_q2"))
    same = F.when(F.lead("stroke_id").over(w) == F.col("stroke_id"), 1).otherwise(0)
    turned = steps.withColumns({"_c1": c1, "_s1": s1, "_c2": c2, "_s2": s2, "same_stroke": same})
    values = {
        "delta_p": F.coalesce(dp, F.lit(0.0)),
        "delta_q": F.coalesce(dq, F.lit(0.0)),
        "sin_alpha": F.coalesce("_s1", F.lit(0.0)),
        "cos_alpha": F.coalesce("_c1", F.lit(1.0)),
        "sin_beta": F.coalesce(F.expr("_s1 * _c2 - _c1 * _s2"), F.lit(0.0)),
        "cos_beta": F.coalesce(F.expr("_c1 * _c2 + _s1 * _s2"), F.lit(1.0)),
    }
    done = turned.withColumns({k: round6(v) for k, v in values.items()}).withColumn("diff_stroke", 1 - F.col("same_stroke"))
    return done.drop("_p1", "_q1", "_p2", "_q2", "_c1", "_s1", "_c2", "_s2")


def trajectory_features(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Frames to points with features: keys, idx (from 0), stroke_id, p, q, FEATURES.

    All windows share keys and order: one exchange and one sort.
    """
    points = with_stroke_ids(frames, keys, order).where("down")
    w = Window.partitionBy(*keys).orderBy(*order)
    found = features_over(points, w).withColumn("idx", F.row_number().over(w) - 1)
    return found.select(*keys, "idx", "stroke_id", "p", "q", *FEATURES)


def ink_segments(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Points with the previous point of the same stroke, null at its start."""
    points = with_stroke_ids(frames, keys, order).where("down")
    w = Window.partitionBy(*keys, "stroke_id").orderBy(*order)
    return points.withColumns({"from_p": F.lag("p").over(w), "from_q": F.lag("q").over(w)})


def feature_array(points: Column) -> Column:
    """array<struct<p,q,stroke_id>> of a whole sample to array<array<double>>, in the row."""

    def directed(d: Column) -> Column:
        c, s = _direction(d["dp"], d["dq"])
        return F.struct(d["dp"].alias("dp"), d["dq"].alias("dq"), c.alias("c"), s.alias("s"))

    def steps(pts: Column) -> Column:
        back = lambda i: F.get(pts, i - 1)
        move = lambda c, i: F.struct((c["p"] - back(i)["p"]).alias("dp"), (c["q"] - back(i)["q"]).alias("dq"))
        return F.transform(pts, lambda c, i: let(move(c, i), directed))

    def rows(pts: Column, dirs: Column) -> Column:
        def row(c: Column, i: Column) -> Column:
            one, two = F.get(dirs, i), F.get(dirs, i - 1)
            same = F.when(F.get(pts, i + 1)["stroke_id"] == c["stroke_id"], 1.0).otherwise(0.0)
            values = (
                F.coalesce(one["dp"], F.lit(0.0)), F.coalesce(one["dq"], F.lit(0.0)), F.coalesce(one["s"], F.lit(0.0)), F.coalesce(one["c"], F.lit(1.0)),
                F.coalesce(one["s"] * two["c"] - one["c"] * two["s"], F.lit(0.0)), F.coalesce(one["c"] * two["c"] + one["s"] * two["s"], F.lit(1.0)),
            )
            return F.array(*map(round6, values), same, 1 - same)

        return F.transform(pts, row)

    return let(points, lambda pts: let(steps(pts), lambda dirs: rows(pts, dirs)))
