"""Golden cases of features, gestures, sessions, keys and data URLs."""

import pytest
from pyspark.sql import functions as F

from strokeloom.functions import scalar as S
from strokeloom.operators import frames as R
from strokeloom.operators import sessions, strokes
from strokeloom.params import FEATURES, JOINTS, LABELS, TIPS, CaptureRules

GOLDEN = {
    "single": ([(0.5, 0.5, 1)], [[0, 0, 0, 1, 0, 1, 0, 1]]),
    "break": (
        [(0.1, 0.1, 1), (0.4, 0.1, 1), (0.4, 0.5, 1), (0.2, 0.5, 2)],
        [[0, 0, 0, 1, 0, 1, 1, 0], [0.3, 0, 0, 1, 0, 1, 1, 0], [0, 0.4, 1, 0, 1, 0, 0, 1], [-0.2, 0, 0, -1, 1, 0, 0, 1]],
    ),
    "repeat": ([(0.25, 0.25, 1), (0.25, 0.25, 1), (0.5, 0.25, 1)], [[0, 0, 0, 1, 0, 1, 1, 0], [0, 0, 0, 0, 0, 1, 1, 0], [0.25, 0, 0, 1, 0, 0, 0, 1]]),
    "tiny": (
        [(0.5, 0.5, 1), (0.500001, 0.5, 1), (0.500001, 0.500002, 1)],
        [[0, 0, 0, 1, 0, 1, 1, 0], [1e-6, 0, 0, 0.999001, 0, 1, 1, 0], [0, 2e-6, 0.9995, 0, 0.998502, 0, 0, 1]],
    ),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_features(spark, name):
    from pyspark.sql import Window

    points, expected = GOLDEN[name]
    rows = spark.createDataFrame([(1, k, *p) for k, p in enumerate(points)], "s int, i int, p double, q double, stroke_id int")
    long = strokes.features_over(rows, Window.partitionBy("s").orderBy("i")).orderBy("i").select(*FEATURES).collect()
    assert [list(r) for r in long] == expected
    nested = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "p", "q", "stroke_id"))).alias("pts"))
    assert nested.select(strokes.feature_array(F.col("pts"))).first()[0] == expected


def test_round6(spark):
    got = spark.createDataFrame([(-1.5e-6,), (1.5e-6,), (-0.0,)], "v double").select(S.round6(F.col("v"))).collect()
    assert [r[0] for r in got] == [-1e-6, 2e-6, 0.0]


@pytest.mark.parametrize(
    ("up", "expected"),
    [((1, 0, 0, 0), "Draw"), ((1, 1, 1, 1), "Erase"), ((1, 1, 0, 0), "Pen up"), ((0, 1, 1, 1), "Pen up"), ((0, 0, 0, 0), "Pen up")],
)
def test_gesture(spark, up, expected):
    hand = [(0.5, 0.5, 0.0)] * 21
    for (tip, joint), u in zip(list(zip(TIPS, JOINTS, strict=True))[1:], up, strict=True):
        hand[tip], hand[joint] = (0.5, 0.4 if u else 0.6, 0.0), (0.5, 0.5 if u else 0.6, 0.0)  # equal is down
    df = spark.createDataFrame([(hand,)], "h array<struct<x:double,y:double,z:double>>")
    for right in (True, False):
        assert df.select(R.gesture(F.col("h"), F.lit(right))).first()[0] == expected
    none = spark.createDataFrame([(None,)], "h array<struct<x:double,y:double,z:double>>")
    assert none.select(R.gesture(F.col("h"))).first()[0] == "Pen up"


def frames_of(draws, others=(), controls=()):
    rows = [(t, "Draw") for t in draws] + [(t, "Pen up") for t in others] + list(controls)
    return sorted(rows)


def played(rows, rules=CaptureRules()):
    state, out = sessions.Capture(), []
    for ms, action, *outcome in rows:
        if row := sessions.step(1, state, ms * 1000, action, rules, outcome[0] if outcome else ""):
            out.append((row[4] // 1000, row[5], row[6], row[7]))
    return out, state


def test_sessions():
    tens = list(range(0, 1000, 100))
    out, state = played(frames_of(tens, [1000, 2399]))
    assert out == [] and state.points == 10
    assert played(frames_of(tens, [1000, 2399, 2400]))[0] == [(2400, 10, 1, "pause")]
    assert played(frames_of([*range(0, 900, 100), 7000], [900, 6000, 7100, 8500]))[0] == [(8500, 10, 2, "pause")]
    assert played(frames_of([*tens, 5000], [5100, 6500]))[0] == [(6500, 11, 1, "pause")]
    out, state = played(frames_of([*range(0, 20001, 1000), 21000]))
    assert out == [(20000, 21, 1, "cap")] and (state.points, state.strokes, state.sample) == (1, 1, 1)
    assert played(frames_of(range(0, 22501, 2500)))[0] == [(22500, 10, 1, "cap")]
    out, state = played(frames_of([*range(0, 600, 100), 1900, 1901], controls=[(501, "clear")]))
    assert out == [] and state.points == 1 and state.start_us == 1901_000
    assert played(frames_of([0, 100, 300, 400], [200]))[1].strokes == 2


def test_failed_and_manual_saves():
    tens = [(t, "Draw") for t in range(0, 1000, 100)]
    out, state = played([*tens, (1000, "Pen up"), (2400, "Pen up", "save_failed"), (5000, "Pen up")])
    assert out == [] and state.blocked and state.points == 10
    out, _ = played([*tens, (1000, "Pen up"), (2400, "Pen up", "save_failed"), (5000, "Draw"), (5100, "Pen up"), (6500, "Pen up")])
    assert out == [(6500, 11, 2, "pause")]
    assert played([(0, "Draw"), (50, "save")])[0] == [(50, 1, 1, "manual")] and played([(0, "Pen up"), (50, "save")])[0] == []
    busy = CaptureRules(save_latency_us=1_000_000)
    out, state = played([(0, "Draw"), (50, "save"), (100, "Draw"), (1049, "Draw"), (1050, "Draw")], busy)
    assert out == [(50, 1, 1, "manual")] and state.points == 1 and state.start_us == 1_050_000


@pytest.mark.parametrize("n", [9, 10])
def test_least_points(n):
    assert len(played(frames_of(range(0, n * 100, 100), [n * 100, n * 100 + 1400]))[0]) == (n == 10)


KEYS = {
    "  Jane Doe ": "Jane_Doe", "Customer#000000001": "Customer_000000001", "a__b": "a_b", "ঔ/../x": "ঔ_.._x", "..": "..", "___": "x", "": "x", None: "x",
    "café": "café", "\U0001f600ok": "ok", " x ": "x",
}


def test_keys(spark):
    df = spark.createDataFrame(list(KEYS.items()), "raw string, expected string").select("raw", "expected", S.safe_key(F.col("raw"), compose=True).alias("got"))
    for r in df.collect():
        assert r.got == r.expected, r.raw
    again = df.select("got", S.safe_key(F.col("got"), compose=True).alias("twice")).collect()
    assert all(r.got == r.twice for r in again)
    assert spark.range(1).select(S.safe_path_key(F.lit(".."))).first()[0] is None


URLS = [
    ("data:image/png;base64,TWFu", "image/", "image/png", 3, None), ("data:video/webm;codecs=vp9;base64,TW Fu\n", "video/", "video/webm;codecs=vp9", 3, None),
    ("data:image/png;base64,", "image/", None, None, 400), ("data:image/png,abc", "image/", None, None, 400), ("data:text/plain;base64,TQ==", "image/", "text/plain", 1, 400),
    ("data:image/png;base64,TWFuTQ==", "image/", "image/png", 4, None), (None, "image/", None, None, None), ("data:;base64,TWFu", "image/", None, None, 400),
    ("data:image/png;base64,TW Fu", "image/", "image/png", 3, None),
]


@pytest.mark.parametrize("case", URLS)
def test_data_urls(spark, case):
    url, prefix, mime, size, fault = case
    p = S.parse_data_url(F.col("u"))
    row = spark.createDataFrame([(url,)], "u string").select(p["mime"], S.decoded_length(p["payload"]), S.data_url_fault(F.col("u"), prefix)).first()
    assert tuple(row) == (mime, size, fault)


def test_extensions(spark):
    cases = [("MP4", None, "mp4"), ("avi", None, "webm"), (None, "video/mp4;codecs=x", "mp4"), (None, None, "webm"), ("", "video/webm", "webm")]
    for declared, mime, expected in cases:
        df = spark.createDataFrame([(declared, mime)], "d string, m string")
        assert df.select(S.choose_extension(F.col("d"), F.col("m"))).first()[0] == expected


def test_small_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.pad2(F.lit(7))) == "07" and get(S.pad2(F.lit(123))) == "123"
    assert get(S.label_in_domain(F.lit("A"), LABELS)) == LABELS[0] and get(S.label_in_domain(F.lit(LABELS[3]), LABELS)) == LABELS[3]
    assert get(S.trim_slashes(F.lit("//a/b/"))) == "a/b" and get(S.status_for(F.lit(503))) == 500 and get(S.status_for(F.lit(413))) == 413
    assert get(S.clamp(F.lit(float("nan")), 0.0, 1.0)) != get(S.clamp(F.lit(2.0), 0.0, 1.0)) == 1.0
    assert get(S.megabytes(F.lit(10 * 1024 * 1024))) == 10
    assert len(get(S.base36_suffix(F.lit("x")))) <= 6
    assert get(S.to_data_url(F.lit("image/png"), F.lit(b"Man"))) == "data:image/png;base64,TWFu"
