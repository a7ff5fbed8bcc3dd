"""Queries on sample sessions, with recursive DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom.operators import frames as R
from strokeloom.operators import sessions
from strokeloom.functions import scalar as S
from strokeloom.operators.samples import collect_samples, media_names, metadata_document, saved_counter
from strokeloom.params import LABELS, IngestRules
from strokeloom.params import SURROGATE as RULES
from strokeloom.plans.trajectories import FRAMES_SQL, features_sql
from strokeloom.schemas import METADATA
from strokeloom.shared import new_folder
from strokeloom.sources import tables
from strokeloom.sources.sink import SampleStore
from strokeloom.streaming.sessions import closed_samples


def _rows(frames: DataFrame) -> DataFrame:
    return frames.select("session_id", "us", F.col("event_id").alias("seq"), F.col("gesture").alias("action"), F.lit("").alias("outcome"))


def sample_sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fold(_rows(tables.event_frames(spark, sf_dir)), RULES)


def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_sessions_batch(spark, sf_dir).groupBy("session_id", "reason").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("num_points").alias("points"), F.max("num_points").alias("most_points"),
        F.sum("num_strokes").alias("strokes"), F.min("start_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )


def saved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saved_counter(sample_sessions_batch(spark, sf_dir), ["session_id"], ["sample"])
    return found.select("session_id", "sample", F.col("saved").cast("long").alias("saved"))


def pause_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.follow(_rows(tables.event_frames(spark, sf_dir)), RULES)
    return found.select("session_id", F.col("seq").alias("event_id"), "sample", "num_points", "progress", "reason")


def clear_cooldown_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are clears here."""
    rows = tables.event_frames(spark, sf_dir)
    kept = R.outside_cooldown(rows.where("gesture <> 'Pen up'"), rows.where("gesture = 'Pen up'"), RULES)
    return kept.select("session_id", "event_id", "us", "gesture")


def recorder_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the chunks that are not empty and of the session's current recorder; others came too late."""
    events = tables.table(spark, sf_dir, "events")
    data = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).cast("binary")
    chunks = events.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 3).alias("recorder"), F.col("event_id").alias("chunk_idx"), data.alias("data"))
    current = chunks.groupBy("session_id").agg(F.max_by("recorder", "chunk_idx").alias("recorder"))
    kept = R.live_chunks(chunks, current)
    return kept.groupBy("session_id", "recorder").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("bytes"))


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' file as a stream: closed samples, committed batch by batch and read back."""
    stream = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "view", "purchase"), "Draw").when(kind == "signup", "Erase").otherwise("Pen up")
    rows = stream.select(
        F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"),
        action.alias("action"), F.lit("").alias("outcome"),
    )
    out, marks = new_folder(spark, "stream"), new_folder(spark, "stream-marks")
    query = closed_samples(rows, RULES).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(sessions.CLOSED.format(session="long")).parquet(out)


def _controlled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames, controls = tables.event_controls(spark, sf_dir)
    return frames, sessions.with_controls(frames.withColumn("action", F.col("gesture")), controls, RULES)


def controlled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples where saves are asked for, fail, take time and are cleared away."""
    return sessions.fold(_controlled(spark, sf_dir)[1], RULES)


def controlled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each row: its sample, whether it is a point of it, and the sample so far."""
    found = sessions.follow(_controlled(spark, sf_dir)[1], RULES)
    return found.select("session_id", F.col("seq").alias("event_id"), "sample", "num_points", F.col("stroke_id").cast("long").alias("num_strokes"), "reason", "counted")


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From frames and controls to the store and back: points get their sample's number, become a
    trajectory with features and a document, which is committed and read again."""
    frames, rows = _controlled(spark, sf_dir)
    closed = sessions.fold(rows, RULES, keep_open=False)
    trajectories = collect_samples(sessions.sample_points(frames, rows, RULES), ["session_id", "sample"])
    name = F.concat_ws("_", F.col("session_id").cast("string"), F.col("sample").cast("string"))
    some = F.when(F.col("sample") % 2 == 0, F.lit("x"))
    full = closed.join(trajectories, ["session_id", "sample"]).withColumns({
        "sample_id": name, "username": F.concat(F.lit(" user"), F.col("session_id").cast("string"), F.lit(" ")), "label": F.lit(LABELS[3]),
        "created_at": F.timestamp_micros("close_us"), "auto_saved": F.col("reason") != "manual", "user_agent": F.lit("none"),
        "media": media_names(name, F.lit("x"), some, F.lit("webm"), F.lit("video/webm")),
    })
    document = metadata_document(full, IngestRules(), RULES)
    path = F.concat(F.lit("output/"), "username", F.lit("/"), "sample_id", F.lit(".json"))
    files = document.withColumn("username", S.safe_key(F.col("username"))).select("username", "label", path.alias("path"), F.to_json("metadata").cast("binary").alias("content"))
    store = SampleStore(spark, new_folder(spark, "samples"))
    store.commit(files, "samples")
    read = store.read().select("path", F.from_json(F.col("content").cast("string"), METADATA).alias("m"))
    t = F.col("m.trajectory")
    last = lambda k: F.transform(t["features_8d"], lambda x: F.get(x, F.lit(k)))
    return read.select(
        "path", F.col("m.sample_id").alias("sample_id"), F.col("m.username").alias("username"), F.col("m.auto_saved").alias("auto_saved"), F.col("m.created_at").alias("created_at"),
        F.col("m.media.video").alias("video"), t["num_points"].cast("long").alias("num_points"), t["num_strokes"].cast("long").alias("num_strokes"),
        F.array_max(last(0)).alias("most_delta_p"), F.array_min(last(3)).alias("least_cos_alpha"), F.array_max(last(4)).alias("most_sin_beta"),
        F.aggregate(last(6), F.lit(0.0), lambda a, x: a + x).cast("long").alias("same_strokes"),
    )


_N = RULES.min_points
SESSIONS_SQL = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS rn FROM frames),
steps AS (
  SELECT session_id, rn, us, event_id, down, 0::BIGINT AS sample, CASE WHEN down THEN 1 ELSE 0 END::BIGINT AS points, CASE WHEN down THEN 1 ELSE 0 END::BIGINT AS strokes,
    CASE WHEN down THEN us END AS start_us, CASE WHEN down THEN us END AS last_us, ''::VARCHAR AS reason
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, us, event_id, down, sample, points, strokes, start_us, last_us,
    CASE WHEN start_us IS NULL OR points < {_N} THEN '' WHEN NOT down AND us - last_us >= {RULES.pause_us} THEN 'pause' WHEN us - start_us >= {RULES.cap_us} THEN 'cap' ELSE '' END
  FROM (
    SELECT n.session_id, n.rn, n.us, n.event_id, n.down, s.sample + CASE WHEN s.reason <> '' THEN 1 ELSE 0 END AS sample,
      CASE WHEN s.reason <> '' THEN 0 ELSE s.points END + CASE WHEN n.down THEN 1 ELSE 0 END AS points,
      CASE WHEN s.reason <> '' THEN 0 ELSE s.strokes END + CASE WHEN n.down AND (s.reason <> '' OR NOT s.down) THEN 1 ELSE 0 END AS strokes,
      coalesce(CASE WHEN s.reason = '' THEN s.start_us END, CASE WHEN n.down THEN n.us END) AS start_us,
      CASE WHEN n.down THEN n.us WHEN s.reason = '' THEN s.last_us END AS last_us
    FROM steps s JOIN numbered n ON n.session_id = s.session_id AND n.rn = s.rn + 1)),
samples AS (
  SELECT session_id, sample, start_us, last_us, us AS close_us, points AS num_points, strokes AS num_strokes, reason FROM steps WHERE reason <> ''
  UNION ALL
  SELECT session_id, sample, start_us, last_us, NULL, points, strokes, 'open' FROM steps
  WHERE reason = '' AND start_us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) = 1
    AND rn = (SELECT max(rn) FROM numbered m WHERE m.session_id = steps.session_id))"""
_WITH = f"WITH RECURSIVE {FRAMES_SQL.lstrip()}, {SESSIONS_SQL}"

CONTROLS_SQL = f"""
told AS (
  SELECT session_id, us, event_id, p, q, CASE WHEN gesture = 'Pen up' AND event_id % 5 < 4 THEN ['clear', 'save', 'save_failed', 'save_ok'][event_id % 5 + 1] ELSE gesture END AS action
  FROM frames),
ended AS (
  SELECT *, (SELECT min((e.us, e.event_id, e.action)) FROM told e WHERE e.session_id = t.session_id AND e.action IN ('clear', 'save_ok', 'save_failed')
      AND (e.us, e.event_id) > (t.us, t.event_id)) AS e FROM told t WHERE action NOT IN ('save_ok', 'save_failed')),
rows_ AS (
  SELECT session_id, us, event_id, p, q, action, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS rn,
    CASE WHEN e IS NULL THEN '' WHEN e[1] - us > {RULES.save_timeout_us} THEN 'save_failed' WHEN e[3] = 'clear' THEN 'aborted' ELSE e[3] END AS outcome,
    CASE WHEN e IS NULL THEN -1 ELSE least(e[1], us + {RULES.save_timeout_us}) END AS until FROM ended),
walk AS (
  SELECT session_id, 0::BIGINT AS rn, 0::BIGINT AS us, 0::BIGINT AS event_id, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0::BIGINT AS sample, 0::BIGINT AS points, 0::BIGINT AS strokes, NULL::BIGINT AS start_us,
    NULL::BIGINT AS last_us, false AS was_down, false AS blocked, -1::BIGINT AS clear_until, -1::BIGINT AS busy, ''::VARCHAR AS reason, false AS counted,
    0::BIGINT AS o_sample, 0::BIGINT AS o_points, 0::BIGINT AS o_strokes, NULL::BIGINT AS o_start, NULL::BIGINT AS o_last
  FROM (SELECT DISTINCT session_id FROM rows_)
  UNION ALL
  SELECT session_id, rn, us, event_id, p, q, CASE WHEN kept THEN sample + 1 ELSE sample END, CASE WHEN wiped THEN 0 ELSE points END, CASE WHEN wiped THEN 0 ELSE strokes END,
    CASE WHEN NOT wiped THEN start_us END, CASE WHEN NOT wiped THEN last_us END, was_down AND NOT wiped, (blocked OR (closing <> '' AND outcome = 'save_failed')) AND NOT wiped,
    CASE WHEN act = 'clear' THEN us + {RULES.cooldown_us} ELSE clear_until END, CASE WHEN act = 'clear' THEN -1 WHEN closing <> '' AND until <> -1 THEN until ELSE busy END,
    CASE WHEN kept THEN closing ELSE '' END, counted, sample, CASE WHEN act = 'clear' THEN 0 ELSE points END, CASE WHEN act = 'clear' THEN 0 ELSE strokes END, start_us, last_us
  FROM (
    SELECT *, closing <> '' AND outcome NOT IN ('save_failed', 'aborted') AS kept, act = 'clear' OR (closing <> '' AND outcome NOT IN ('save_failed', 'aborted')) AS wiped FROM (
      SELECT *, CASE WHEN act = 'save' AND points > 0 THEN 'manual' WHEN act <> 'frame' OR start_us IS NULL OR points < {_N} OR blocked THEN ''
        WHEN action <> 'Draw' AND us - last_us >= {RULES.pause_us} THEN 'pause' WHEN us - start_us >= {RULES.cap_us} THEN 'cap' ELSE '' END AS closing
      FROM (
        SELECT session_id, rn, us, event_id, p, q, action, outcome, until, act, sample, clear_until, busy, pen AS counted,
          points + CASE WHEN pen THEN 1 ELSE 0 END AS points, strokes + CASE WHEN pen AND NOT was_down THEN 1 ELSE 0 END AS strokes,
          coalesce(start_us, CASE WHEN pen THEN us END) AS start_us, CASE WHEN pen THEN us ELSE last_us END AS last_us,
          CASE WHEN act = 'frame' THEN action = 'Draw' ELSE was_down END AS was_down, blocked AND NOT pen AS blocked
        FROM (
          SELECT *, act = 'frame' AND action = 'Draw' AS pen FROM (
            SELECT w.session_id, n.rn, n.us, n.event_id, n.p, n.q, n.action, n.outcome, n.until, w.sample, w.points, w.strokes, w.start_us, w.last_us, w.was_down, w.blocked, w.clear_until, w.busy,
              CASE WHEN n.action = 'clear' THEN 'clear' WHEN n.us < w.busy THEN 'skip' WHEN n.action = 'save' THEN 'save' WHEN n.us < w.clear_until THEN 'skip' ELSE 'frame' END AS act
            FROM walk w JOIN rows_ n ON n.session_id = w.session_id AND n.rn = w.rn + 1)))))),
saved AS (
  SELECT session_id, o_sample AS sample, o_start AS start_us, o_last AS last_us, us AS close_us, o_points AS num_points, o_strokes AS num_strokes, reason FROM walk WHERE reason <> '')"""
_CONTROLLED = f"WITH RECURSIVE {FRAMES_SQL.lstrip()}, {CONTROLS_SQL}"
_DOCUMENTS = f"""{_CONTROLLED},
placed AS (
  SELECT w.session_id || '_' || w.o_sample AS sample_id, w.us, w.event_id, w.p, w.q, w.o_strokes AS stroke_id FROM walk w JOIN saved s
    ON s.session_id = w.session_id AND s.sample = w.o_sample WHERE w.counted AND w.us >= s.start_us AND w.us <= s.last_us), {features_sql("placed", "sample_id", "us, event_id")}
SELECT 'output/user' || session_id || '/' || sample_id || '.json' AS path, sample_id, 'user' || session_id AS username, reason <> 'manual' AS auto_saved,
  strftime(make_timestamp(close_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at, CASE WHEN sample % 2 = 0 THEN sample_id || '.webm' END AS video, num_points, num_strokes,
  max(delta_p) AS most_delta_p, min(cos_alpha) AS least_cos_alpha, max(sin_beta) AS most_sin_beta, sum(same_stroke)::BIGINT AS same_strokes
FROM (SELECT *, session_id || '_' || sample AS sample_id FROM saved) JOIN features USING (sample_id) GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (sample_sessions_batch, sample_summary, saved_samples, pause_progress, clear_cooldown_antijoin, stream_sessions, controlled_sessions, controlled_frames, sample_documents, recorder_fence)}

ORACLE_SQL = {
    "sample_sessions_batch": f"{_WITH} SELECT * FROM samples",
    "sample_summary": f"""{_WITH} SELECT session_id, reason, count(*) AS samples, sum(num_points)::BIGINT AS points, max(num_points) AS most_points,
        sum(num_strokes)::BIGINT AS strokes, min(start_us) AS first_us, max(last_us) AS last_us FROM samples GROUP BY session_id, reason""",
    "saved_samples": f"""{_WITH} SELECT session_id, sample, (count(*) FILTER (WHERE reason <> 'open') OVER (PARTITION BY session_id ORDER BY sample ROWS UNBOUNDED PRECEDING))::BIGINT AS saved FROM samples""",
    "pause_progress": f"""{_WITH} SELECT session_id, event_id, sample, points AS num_points,
        CASE WHEN NOT down AND start_us IS NOT NULL AND points >= {_N} THEN least((us - last_us) / {RULES.pause_us}, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS progress, reason FROM steps""",
    "clear_cooldown_antijoin": f"""WITH {FRAMES_SQL} SELECT session_id, event_id, us, gesture FROM frames f WHERE gesture <> 'Pen up' AND NOT EXISTS (
        SELECT 1 FROM frames c WHERE c.gesture = 'Pen up' AND c.session_id = f.session_id AND c.us <= f.us AND f.us - c.us < {RULES.cooldown_us})""",
    "controlled_sessions": f"""{_CONTROLLED} SELECT * FROM saved
        UNION ALL SELECT session_id, sample, start_us, last_us, NULL, points, strokes, 'open' FROM walk w WHERE start_us IS NOT NULL AND rn = (SELECT max(rn) FROM rows_ r WHERE r.session_id = w.session_id)""",
    "controlled_frames": f"""{_CONTROLLED} SELECT session_id, event_id, CASE WHEN reason <> '' THEN o_sample ELSE sample END AS sample, o_points AS num_points, o_strokes AS num_strokes, reason, counted
        FROM walk WHERE rn > 0""",
    "sample_documents": _DOCUMENTS,
    "recorder_fence": """WITH c AS (SELECT user_id AS session_id, event_id % 3 AS recorder, event_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS data FROM events),
        n AS (SELECT session_id, arg_max(recorder, event_id) AS recorder FROM c GROUP BY session_id)
        SELECT session_id, recorder, count(*) AS chunks, sum(strlen(data))::BIGINT AS bytes FROM c JOIN n USING (session_id, recorder) WHERE data <> '' GROUP BY ALL""",
    "stream_sessions": f"{_WITH} SELECT * FROM samples WHERE reason <> 'open'",
}
