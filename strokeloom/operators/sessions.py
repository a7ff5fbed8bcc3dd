"""Sample sessions: one step function for batch and stream.

A sample opens at a pen-down frame. It closes at an observed frame without pen after the pause, or
at any frame once it is as long as the cap, and only with enough points; a shorter one stays open
and goes on. A close depends on a count that the last close reset, so no fixed window finds it: the
rows of a session are folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokeloom.params import CLEAR, FAILED, SAVE, SAVED, CaptureRules

NONE = -1  # a time that isn't set


@dataclass
class Capture:
    """State of one session."""

    sample: int = 0
    started: bool = False
    start_us: int = NONE
    last_us: int = NONE
    points: int = 0
    strokes: int = 0
    was_down: bool = False
    ink: bool = False
    blocked: bool = False
    clear_until: int = NONE
    busy_until: int = NONE
    outcome: str = ""  # of the save under way

    def reset(self) -> None:
        self.started, self.start_us, self.last_us = False, NONE, NONE
        self.points = self.strokes = 0
        self.was_down = self.ink = self.blocked = False


STATE = "sample long, started boolean, start_us long, last_us long, points long, strokes long, was_down boolean, ink boolean, blocked boolean, clear_until long, busy_until long, outcome string"
CLOSED = "session_id {session}, sample long, start_us long, last_us long, close_us long, num_points long, num_strokes long, reason string"


PROGRESS = "session_id {session}, us long, seq long, sample long, num_points long, progress double, reason string, counted boolean, stroke_id int"
ABORTED = "aborted"  # by a clear that came before the save's outcome


def with_controls(frames: DataFrame, controls: DataFrame, rules: CaptureRules) -> DataFrame:
    """frames and controls, both (session_id, us, seq, action), as input of fold.

    Every row that may start a save is told how that save would end: by the next outcome (save_ok or
    save_failed) of its session, or by a clear that comes before it; `until` says when. An outcome
    after the time-out is a failure at the time-out; where nothing follows, the save ends at once.
    """
    rows = frames.select("session_id", "us", "seq", "action").unionByName(controls.select("session_id", "us", "seq", "action"))
    # Backwards, so that the next outcome is a running value and not a search from every row.
    later = Window.partitionBy("session_id").orderBy(F.desc("us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("action").isin(SAVED, FAILED, CLEAR), F.struct("action", "us"))
    rows = rows.withColumn("_end", F.last(ends, ignorenulls=True).over(later)).where(~F.col("action").isin(SAVED, FAILED))
    late = F.col("_end.us") - F.col("us") > rules.save_timeout_us
    outcome = F.when(F.col("_end").isNull(), "").when(late, FAILED).when(F.col("_end.action") == CLEAR, ABORTED).otherwise(F.col("_end.action"))
    until = F.when(F.col("_end").isNull(), F.lit(NONE).cast("long")).otherwise(F.least(F.col("_end.us"), F.col("us") + rules.save_timeout_us))
    return rows.select("session_id", "us", "seq", "action", outcome.alias("outcome"), until.alias("until"))


def schema_for(pattern: str, rows: DataFrame) -> str:
    """The schema with the type that rows have for a session's id."""
    return pattern.format(session=dict(rows.dtypes)["session_id"])


def _folded(rows: DataFrame, pattern: str, visit, finish) -> DataFrame:
    """Rows dealt by session, sorted by the engine, and passed by one state at a time in batches.

    visit(session, state, us, seq, action, outcome, until) and finish(session, state) give a row or
    None. Memory doesn't grow with a session, however long.
    """
    rows = rows if "until" in rows.columns else rows.withColumn("until", F.lit(NONE).cast("long"))
    ordered = rows.select("session_id", "us", "seq", "action", "outcome", "until").repartition("session_id").sortWithinPartitions("session_id", "us", "seq")
    schema = schema_for(pattern, rows)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, begun = None, Capture(), False
        kind = None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, kind if k == 0 else TYPES[t]) for k, (x, t) in enumerate(zip(zip(*out, strict=True), types, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names)

        types = [c.split()[1] for c in schema.split(", ")]
        for batch in batches:
            kind, out = batch.column(0).type, []
            for key, us, seq, action, outcome, until in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != session or not begun:
                    if begun and (row := finish(session, state)):
                        out.append(row)
                    session, state, begun = key, Capture(), True
                if row := visit(key, state, us, seq, action, outcome, until):
                    out.append(row)
            if out:
                yield packed(out)
        if begun and (row := finish(session, state)):
            yield packed([row])

    return ordered.mapInArrow(run, schema)


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def summary(session, state: Capture, close_us: int | None, reason: str) -> tuple:
    return (session, state.sample, state.start_us, state.last_us, close_us, state.points, state.strokes, reason)


def _save(session, state: Capture, us: int, reason: str, rules: CaptureRules, outcome: str, until: int) -> tuple | None:
    """The saved sample, or None if the save fails or a clear aborts it; frames are ignored until the
    save is over."""
    if until != NONE:
        state.busy_until = until
    elif rules.save_latency_us:
        state.busy_until = us + rules.save_latency_us
    if outcome == ABORTED:
        return None
    if outcome == FAILED:
        state.blocked = True
        return None
    row = summary(session, state, us, reason)
    state.reset()
    state.sample += 1
    return row


def step(session, state: Capture, us: int, action: str, rules: CaptureRules, outcome: str = "", until: int = NONE) -> tuple | None:
    """Moves state on by one row and returns the sample that it closes, if any.

    action: Draw, Erase or Pen up for a frame; save or clear for a control. outcome: save_failed if
    a save that this row starts fails, aborted if a clear ends it; until: when it is over.
    """
    if action == CLEAR:
        state.reset()
        state.busy_until, state.clear_until = NONE, us + rules.cooldown_us
        return None
    if state.busy_until != NONE and us < state.busy_until:
        return None
    if action == SAVE:
        if state.points < rules.min_points and not state.ink:
            return None
        return _save(session, state, us, "manual", rules, outcome, until)
    if us < state.clear_until:
        return None
    down = action == "Draw"
    if down:
        if not state.started:
            state.started, state.start_us = True, us
        if not state.was_down:
            state.strokes += 1
        state.points += 1
        state.last_us, state.ink, state.blocked = us, True, False
    state.was_down = down
    if not state.started or state.points < rules.min_points or state.blocked:
        return None
    if not down and us - state.last_us >= rules.pause_us:
        return _save(session, state, us, "pause", rules, outcome, until)
    if us - state.start_us >= rules.cap_us:
        return _save(session, state, us, "cap", rules, outcome, until)
    return None


def fold(rows: DataFrame, rules: CaptureRules, keep_open: bool = True) -> DataFrame:
    """rows: (session_id, us, seq, action, outcome[, until]). Closed samples, and open ones with reason `open`."""

    def visit(session, state: Capture, us: int, seq: int, action: str, outcome: str, until: int) -> tuple | None:
        return step(session, state, us, action, rules, outcome, until)

    def finish(session, state: Capture) -> tuple | None:
        return summary(session, state, None, "open") if keep_open and state.started else None

    return _folded(rows, CLOSED, visit, finish)


def follow(rows: DataFrame, rules: CaptureRules) -> DataFrame:
    """Every row with its sample, the points and strokes so far, whether it is a point of the sample,
    and the pause's progress in [0, 1]."""

    def visit(session, state: Capture, us: int, seq: int, action: str, outcome: str, until: int) -> tuple:
        before, number = state.points, state.sample
        closed = step(session, state, us, action, rules, outcome, until)
        if closed:
            sample, last, points, strokes, able = closed[1], closed[3], closed[5], closed[6], True
        else:
            sample, last, points, strokes = state.sample, state.last_us, state.points, state.strokes
            able = state.started and points >= rules.min_points and not state.blocked
        counted = action == "Draw" and sample == number and points == before + 1
        progress = min((us - last) / rules.pause_us, 1.0) if able and action != "Draw" else 0.0
        return session, us, seq, sample, points, progress, closed[7] if closed else "", counted, strokes

    return _folded(rows, PROGRESS, visit, lambda session, state: None)


def sample_points(frames: DataFrame, rows: DataFrame, rules: CaptureRules) -> DataFrame:
    """frames: (session_id, us, seq, p, q); rows: of with_controls. The points of closed samples:
    session_id, sample, idx, p, q, stroke_id."""
    seen = follow(rows, rules)
    closed = fold(rows, rules, keep_open=False).select("session_id", "sample", "start_us")
    # A failed or cleared sample keeps its number for the next one; points before its start are not in it.
    mine = seen.where("counted").join(closed, ["session_id", "sample"]).where("us >= start_us")
    points = mine.select("session_id", "us", "seq", "sample", (F.col("num_points") - 1).cast("int").alias("idx"), "stroke_id")
    return points.join(frames.select("session_id", "us", "seq", "p", "q"), ["session_id", "us", "seq"]).select("session_id", "sample", "idx", "p", "q", "stroke_id")
