"""Sample sessions over a stream of frames and controls, with the batch fold's step function."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strokeloom.operators.sessions import CLOSED, NONE, STATE, Capture, schema_for, step
from strokeloom.params import CaptureRules


def closed_samples(rows: DataFrame, rules: CaptureRules) -> DataFrame:
    """rows: a stream of (session_id, us, seq, action, outcome[, until]), in order across micro-batches.

    Rows of one micro-batch are sorted by (us, seq). Nothing closes on a timer: a pause ends at an
    observed frame.
    """
    schema = schema_for(CLOSED, rows)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Capture(*held.get) if held.exists else Capture()
        rows = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
        until = rows["until"].tolist() if "until" in rows else [NONE] * len(rows)
        out = []
        for us, action, outcome, end in zip(rows["us"].tolist(), rows["action"].tolist(), rows["outcome"].tolist(), until, strict=True):
            if closed := step(key[0], state, us, action, rules, outcome, end):
                out.append(closed)
        held.update(astuple(state))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("session_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def slices(chunks: DataFrame, width: str) -> DataFrame:
    """Chunks (session_id, ts, data) and their bytes in tumbling slices; partial sums before the shuffle."""
    return chunks.groupBy("session_id", F.window("ts", width).alias("slice")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("bytes"))


def media_slices(chunks: DataFrame, width: str = "250 milliseconds", late: str | None = None) -> DataFrame:
    """slices of a stream; late chunks are waited for by one slice, or as long as `late` says."""
    return slices(chunks.withWatermark("ts", late or width), width)
