"""Queries on frames, strokes, features and ink, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom.functions.scalar import round6
from strokeloom.operators import frames as R
from strokeloom.operators import raster, strokes
from strokeloom.operators.samples import collect_samples, sample_counts
from strokeloom.params import FEATURES, SKELETON, CaptureRules
from strokeloom.sources import tables

KEYS, ORDER = ["session_id"], ["us", "event_id"]
RULES = CaptureRules()
CELL = 32

FRAMES_SQL = """
frames AS (
  SELECT user_id AS session_id, epoch_us(ts) AS us, event_id,
    CASE WHEN event_type IN ('click','view','purchase') THEN 'Draw' WHEN event_type = 'signup' THEN 'Erase' ELSE 'Pen up' END AS gesture,
    event_type IN ('click','view','purchase') AS down,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 500)) AS p,
    CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) / 100 AS q
  FROM events),
strokes AS (
  SELECT *, sum(CASE WHEN down AND NOT coalesce(before, false) THEN 1 ELSE 0 END)
      OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS stroke_id
  FROM (SELECT *, lag(down) OVER (PARTITION BY session_id ORDER BY us, event_id) AS before FROM frames))"""


def features_sql(points: str, key: str, order: str, extra: str = "") -> str:
    """CTEs from points (key, order, p, q, stroke_id) to `features`."""
    w = f"(PARTITION BY {key} ORDER BY {order})"
    r6 = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
    return f"""
lagged AS (
  SELECT *, row_number() OVER {w} - 1 AS idx, lag(p) OVER {w} AS p1, lag(q) OVER {w} AS q1, lag(p, 2) OVER {w} AS p2, lag(q, 2) OVER {w} AS q2,
    CASE WHEN lead(stroke_id) OVER {w} = stroke_id THEN 1 ELSE 0 END AS same_stroke
  FROM {points}),
stepped AS (
  SELECT *, p - p1 AS dp, q - q1 AS dq, sqrt((p - p1) * (p - p1) + (q - q1) * (q - q1)) + 1e-9 AS d1,
    sqrt((p1 - p2) * (p1 - p2) + (q1 - q2) * (q1 - q2)) + 1e-9 AS d2 FROM lagged),
turned AS (SELECT *, dp / d1 AS c1, dq / d1 AS s1, (p1 - p2) / d2 AS c2, (q1 - q2) / d2 AS s2 FROM stepped),
features AS (
  SELECT {key}, CAST(idx AS BIGINT) AS idx, CAST(stroke_id AS INTEGER) AS stroke_id, p, q,
    {r6("coalesce(dp, 0.0)")} AS delta_p, {r6("coalesce(dq, 0.0)")} AS delta_q,
    {r6("coalesce(s1, 0.0)")} AS sin_alpha, {r6("coalesce(c1, 1.0)")} AS cos_alpha,
    {r6("coalesce(s1 * c2 - c1 * s2, 0.0)")} AS sin_beta, {r6("coalesce(c1 * c2 + s1 * s2, 1.0)")} AS cos_beta,
    same_stroke, 1 - same_stroke AS diff_stroke{extra}
  FROM turned)"""


EMBEDDED_POINTS_SQL = """
points AS (
  SELECT vec_id, i AS place, embedding[2 * i + 1]::DOUBLE AS p, embedding[2 * i + 2]::DOUBLE AS q,
    CAST(floor(i * 2 / (len(embedding) / 2)) + 1 AS INTEGER) AS stroke_id
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings))"""


def trajectory_features_8d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strokes.trajectory_features(tables.event_frames(spark, sf_dir), KEYS, ORDER)
    return found.withColumn("idx", F.col("idx").cast("long"))


def trajectory_features_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.embedding_points(spark, sf_dir).withColumn("f", strokes.feature_array(F.col("points")))
    each = rows.select("vec_id", F.posexplode("f").alias("idx", "row"))
    return each.select("vec_id", F.col("idx").cast("long").alias("idx"), *(F.get("row", F.lit(k)).alias(name) for k, name in enumerate(FEATURES)))


def stroke_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strokes.with_stroke_ids(tables.event_frames(spark, sf_dir), KEYS, ORDER)
    return found.select("session_id", "event_id", "down", F.col("stroke_id").cast("long").alias("stroke_id"))


def stroke_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strokes.with_stroke_ids(tables.event_frames(spark, sf_dir), KEYS, ORDER)
    return sample_counts(found, KEYS).withColumn("num_strokes", F.col("num_strokes").cast("long"))


def sample_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = strokes.trajectory_features(tables.event_frames(spark, sf_dir), KEYS, ORDER).select("session_id", "idx", "p", "q", "stroke_id")
    t = F.col("trajectory")
    return collect_samples(points, KEYS).select(
        "session_id", t["num_points"].cast("long").alias("num_points"), t["num_strokes"].cast("long").alias("num_strokes"),
        round6(F.aggregate(t["features_8d"], F.lit(0.0), lambda a, f: a + F.get(f, F.lit(6)))).alias("same_strokes"),
        F.get(F.get(t["features_8d"], F.lit(1)), F.lit(0)).alias("second_delta_p"),
        F.get(F.get(t["points_normalized"], F.lit(0)), F.lit(1)).alias("first_q"),
        F.array_join("trajectory.feature_names", ",").alias("feature_names"),
    )


def ink_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strokes.ink_segments(tables.event_frames(spark, sf_dir), KEYS, ORDER)
    return found.select("session_id", "event_id", F.col("stroke_id").cast("long").alias("stroke_id"), "from_p", "from_q", "p", "q")


def gesture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand, right = F.col("landmarks"), R.is_right(F.col("handedness"))
    rows = tables.embedding_landmarks(spark, sf_dir).select(R.gesture(hand, right).alias("gesture"), right.alias("is_right"), F.get(R.fingers_up(hand, right), F.lit(0)).alias("thumb"))
    return rows.groupBy("gesture", "is_right", "thumb").agg(F.count(F.lit(1)).alias("n"))


def first_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with no hand, one or two: the first decides, and none is a raised pen."""
    rows = tables.embedding_landmarks(spark, sf_dir)
    mirrored = F.transform("landmarks", lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))
    none = F.array().cast(dict(rows.dtypes)["landmarks"].join(("array<", ">")))
    hands = F.when(F.col("vec_id") % 4 == 0, none).when(F.col("vec_id") % 4 == 1, F.array("landmarks")).otherwise(F.array("landmarks", mirrored))
    hand = R.first_hand(F.col("hands"))
    seen = rows.withColumn("hands", hands).withColumn("gesture", R.gesture(hand, R.is_right(F.col("handedness"))))
    return seen.select("vec_id", "gesture", (F.col("gesture") == "Draw").alias("down"), hand.isNotNull().alias("seen"))


def mirror_clamp_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    tip = R.display_point(R.landmark(F.col("landmarks"), 8), RULES.frame_w, RULES.frame_h)
    rows = tables.embedding_landmarks(spark, sf_dir).withColumn("at", tip)
    unit = R.normalised(F.col("at"), RULES.frame_w, RULES.frame_h)
    return rows.select("vec_id", F.col("at.x").alias("x"), F.col("at.y").alias("y"), unit["p"].alias("p"), unit["q"].alias("q"))


def skeleton_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.skeleton_segments(tables.embedding_landmarks(spark, sf_dir), "vec_id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.event_frames(spark, sf_dir).withColumns({"x": F.col("p") * RULES.frame_w, "y": F.col("q") * RULES.frame_h})
    return raster.ink_log(seen, KEYS, ORDER, RULES)


def ink_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


def ink_occupancy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.occupancy(_log(spark, sf_dir), KEYS, ORDER, CELL, RULES)


_HAND_SQL = """
hands AS (
  SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'Left' WHEN vec_id % 3 = 1 THEN 'Right' END AS handedness,
    [embedding[2 * k + 1]::DOUBLE FOR k IN range(0, 21)] AS x, [embedding[2 * k + 2]::DOUBLE FOR k IN range(0, 21)] AS y
  FROM embeddings),
fingers AS (
  SELECT vec_id, coalesce(handedness, 'Right') = 'Right' AS is_right, x, y,
    CASE WHEN coalesce(handedness, 'Right') = 'Right' THEN x[5] < x[4] ELSE x[5] > x[4] END AS thumb,
    y[9] < y[7] AS i, y[13] < y[11] AS m, y[17] < y[15] AS r, y[21] < y[19] AS l FROM hands)"""

_LOG_SQL = f"""
placed AS (SELECT *, p * {RULES.frame_w} AS x, q * {RULES.frame_h} AS y FROM frames),
log AS (
  SELECT session_id, us, event_id, kind, x0, y0, x1, y1, radius FROM (
    SELECT session_id, us, event_id, gesture AS kind, x AS x1, y AS y1,
      CASE WHEN gesture = 'Draw' AND drew THEN px ELSE x END AS x0, CASE WHEN gesture = 'Draw' AND drew THEN py ELSE y END AS y0,
      CASE WHEN gesture = 'Draw' THEN {RULES.brush}::DOUBLE ELSE {RULES.eraser}::DOUBLE END AS radius
    FROM (SELECT *, lag(gesture) OVER w = 'Draw' AS drew, lag(x) OVER w AS px, lag(y) OVER w AS py
      FROM placed WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)))
  WHERE kind IN ('Draw', 'Erase'))"""

_EDGES = ", ".join(f"({a}, {b})" for a, b in SKELETON)

QUERIES = {
    f.__name__: f
    for f in (
        trajectory_features_8d, trajectory_features_array, stroke_ids, stroke_summary, sample_trajectories, ink_segments, gesture_counts,
        first_hands, mirror_clamp_normalise, skeleton_segments, ink_log, ink_occupancy_grid,
    )
}

ORACLE_SQL = {
    "trajectory_features_8d": f"WITH {FRAMES_SQL}, points AS (SELECT * FROM strokes WHERE down), {features_sql('points', 'session_id', 'us, event_id')} SELECT * FROM features",
    "trajectory_features_array": f"""WITH {EMBEDDED_POINTS_SQL}, {features_sql("points", "vec_id", "place")}
        SELECT vec_id, idx, {", ".join(FEATURES[:6])}, same_stroke::DOUBLE AS same_stroke, diff_stroke::DOUBLE AS diff_stroke FROM features""",
    "stroke_ids": f"WITH {FRAMES_SQL} SELECT session_id, event_id, down, stroke_id::BIGINT AS stroke_id FROM strokes",
    "stroke_summary": f"""WITH {FRAMES_SQL} SELECT session_id, count(*) FILTER (WHERE down) AS num_points,
        coalesce(max(stroke_id) FILTER (WHERE down), 0)::BIGINT AS num_strokes, min(us) FILTER (WHERE down) AS first_us,
        max(us) FILTER (WHERE down) AS last_us, coalesce(bool_or(down), false) AS has_ink FROM strokes GROUP BY session_id""",
    "sample_trajectories": f"""WITH {FRAMES_SQL}, points AS (SELECT * FROM strokes WHERE down), {features_sql("points", "session_id", "us, event_id")}
        SELECT session_id, count(*) AS num_points, max(stroke_id)::BIGINT AS num_strokes, sum(same_stroke)::DOUBLE AS same_strokes,
          max(delta_p) FILTER (WHERE idx = 1) AS second_delta_p, max(q) FILTER (WHERE idx = 0) AS first_q,
          '{",".join(FEATURES)}' AS feature_names FROM features GROUP BY session_id""",
    "ink_segments": f"""WITH {FRAMES_SQL} SELECT session_id, event_id, stroke_id::BIGINT AS stroke_id, lag(p) OVER w AS from_p, lag(q) OVER w AS from_q, p, q
        FROM strokes WHERE down WINDOW w AS (PARTITION BY session_id, stroke_id ORDER BY us, event_id)""",
    "gesture_counts": f"""WITH {_HAND_SQL} SELECT CASE WHEN i AND NOT m AND NOT r AND NOT l THEN 'Draw' WHEN i AND m AND r AND l THEN 'Erase' ELSE 'Pen up' END AS gesture,
        is_right, thumb, count(*) AS n FROM fingers GROUP BY ALL""",
    "first_hands": f"""WITH {_HAND_SQL}, told AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'Pen up' WHEN i AND NOT m AND NOT r AND NOT l THEN 'Draw'
          WHEN i AND m AND r AND l THEN 'Erase' ELSE 'Pen up' END AS gesture FROM fingers)
        SELECT vec_id, gesture, gesture = 'Draw' AS down, vec_id % 4 <> 0 AS seen FROM told""",
    "mirror_clamp_normalise": f"""WITH {_HAND_SQL}, pixels AS (SELECT vec_id, greatest(0.0::DOUBLE, least({RULES.frame_w}::DOUBLE, (1 - x[9]) * {RULES.frame_w})) AS x,
        greatest(0.0::DOUBLE, least({RULES.frame_h}::DOUBLE, y[9] * {RULES.frame_h})) AS y FROM hands)
        SELECT vec_id, x, y, x / {RULES.frame_w} AS p, y / {RULES.frame_h} AS q FROM pixels""",
    "skeleton_segments": f"""WITH {_HAND_SQL}, edges(a, b) AS (VALUES {_EDGES})
        SELECT vec_id, a, b, x[a + 1] AS ax, y[a + 1] AS ay, x[b + 1] AS bx, y[b + 1] AS "by" FROM hands, edges""",
    "ink_log": f"WITH {FRAMES_SQL}, {_LOG_SQL} SELECT * FROM log",
    "ink_occupancy_grid": f"""WITH {FRAMES_SQL}, {_LOG_SQL},
        spots AS (SELECT *, (cx + 0.5::DOUBLE) * {CELL} AS mx, (cy + 0.5::DOUBLE) * {CELL} AS my FROM log, range(0, {-(-RULES.frame_w // CELL)}) a(cx), range(0, {-(-RULES.frame_h // CELL)}) b(cy)),
        sized AS (SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS size FROM spots),
        along AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE ((mx - x0) * (x1 - x0) + (my - y0) * (y1 - y0)) / size END)) AS t FROM sized),
        off AS (SELECT *, x0 + t * (x1 - x0) - mx AS ex, y0 + t * (y1 - y0) - my AS ey FROM along)
        SELECT session_id, cx::INTEGER AS cx, cy::INTEGER AS cy FROM off WHERE ex * ex + ey * ey <= radius * radius
        GROUP BY session_id, cx, cy HAVING arg_max(kind, (us, event_id)) = 'Draw'""",
}
