"""Ingest, store, streams and frames end to end."""

import json

import pytest
from pyspark.sql import functions as F

from strokeloom.operators import frames as R
from strokeloom.operators import ingest, sessions
from strokeloom.operators.samples import metadata_document
from strokeloom.params import CaptureRules, IngestRules
from strokeloom.sources import tables
from strokeloom.sources.sink import CommitConflict, SampleStore, commit_stream
from strokeloom.streaming.sessions import closed_samples

def now():
    return F.lit("2026-01-02 03:04:05.678").cast("timestamp")


def built(spark, body, rules=IngestRules()):
    df = spark.createDataFrame([(body if isinstance(body, str) or body is None else json.dumps(body), "seed")], "body string, seed string")
    return ingest.build_sample_files(tables.parse_requests(df).where("body_status is null"), rules, now())


PNG = {"dataUrl": "data:image/png;base64,TWFu"}
MP4 = {"dataUrl": "data:video/mp4;codecs=x;base64,TWFuTQ=="}


def test_ingest_merges_and_names(spark):
    body = {"username": "", "label": "ঔ", "sampleId": "s1", "image": PNG, "video": MP4, "metadata": {"username": "Jane Doe", "own": {"a": [1, 2]}, "label": "old"}}
    row = built(spark, body).first()
    assert row.status is None and [f.path for f in row.files] == [f"output/Jane_Doe/ঔ/ঔ_s1.{x}" for x in ("png", "mp4", "json")]
    stored = json.loads(row.files[2].content.decode())
    assert stored["own"] == {"a": [1, 2]} and stored["label"] == "ঔ" and stored["repository"]["paths"]["video"].endswith("s1.mp4")
    assert stored["created_at"] == stored["uploaded_at"] == "2026-01-02T03:04:05.678Z"
    assert row.total_bytes == sum(len(f.content) for f in row.files) and row.message == "Add sample Jane_Doe/ঔ/s1"


def test_ingest_defaults(spark):
    row = built(spark, {"image": PNG}).first()
    assert row.username == "anonymous" and row.label == "unknown" and row.sample_id.startswith("20260102_030405_") and row.video_path is None


@pytest.mark.parametrize(
    ("body", "status"),
    [({}, 400), ("", 400), ({"image": {"dataUrl": "x"}}, 400), ({"image": MP4}, 400), ({"video": PNG}, 400), ({"image": PNG, "username": ".."}, 400), ({"video": MP4}, None)],
)
def test_ingest_status(spark, body, status):
    assert built(spark, body).first().status == status


def test_ingest_cap_and_key(spark):
    size = built(spark, {"image": PNG, "sampleId": "a"}).first().total_bytes
    for most, status in ((size, None), (size - 1, 413)):
        assert built(spark, {"image": PNG, "sampleId": "a"}, IngestRules(max_bytes=most)).first().status == status
    rules = IngestRules(upload_key="k")
    assert built(spark, {"image": PNG}, rules).first().status == 401 and built(spark, {"image": PNG, "uploadKey": "k"}, rules).first().status is None


def test_bodies(spark):
    df = spark.createDataFrame([("{oops",), ("[1]",), ("{}",), (None,), ("{" + " " * 100 + "}",)], "body string")
    assert [r.body_status for r in tables.parse_requests(df, 50).collect()] == [400, 400, None, None, 413]
    with pytest.raises(ValueError):
        tables.checked_rules("no slash", "t")
    assert tables.checked_rules("a/b", "t", output_dir="/out/", branch="").output_dir == "out"


def test_store_conflict_and_retry(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("u", "l", "p1", bytearray(b"a"))], "username string, label string, path string, content binary")
    assert store.commit(rows, "one") == 1
    heads = [store.head()]
    real = store.head
    # Another writer takes version 2 after this one has read the head.
    assert SampleStore(spark, f"file://{tmp_path}/s").commit(rows.withColumn("path", F.lit("p2")), "two") == 2
    stale = iter([heads[0], heads[0]])
    store.head = lambda: next(stale, None) or real()
    assert store.commit(rows.withColumn("content", F.lit(b"b")), "three") == 3
    store.head = lambda: heads[0]
    with pytest.raises(CommitConflict):
        store.commit(rows, "four")
    store.head = real
    assert {r.path: bytes(r.content) for r in store.read().collect()} == {"p1": b"b", "p2": b"a"}
    assert {r.path for r in store.read(1).collect()} == {"p1"}


def test_stream_commits_each_batch_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"username": f"u{k}", "sampleId": str(k), "image": PNG}) + "\n")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).select(F.col("value").alias("body"), F.col("value").alias("seed"))
    files = ingest.build_sample_files(tables.parse_requests(lines), IngestRules(), now())
    store = SampleStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        commit_stream(files, store, f"file://{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    assert store.head()[0] == 3 and store.read().count() == 6


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_stream_equals_batch(spark, tmp_path, cuts):
    rules = CaptureRules()
    rows = []
    for s in range(4):
        for k in range(120):
            rows.append((s, k * 137_000 * (1 + (k % 17 == 0) * 12), k, "Draw" if (k * 7 + s) % 9 < 6 else "Pen up", ""))
    rows = [(s, us, k, a, o) for s, us, k, a, o in sorted(rows, key=lambda r: r[1])]
    schema = "session_id long, us long, seq long, action string, outcome string"
    df = spark.createDataFrame(rows, schema)
    batch = sorted(map(tuple, sessions.fold(df, rules, keep_open=False).collect()))
    step = -(-len(rows) // cuts)
    for k in range(cuts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = closed_samples(stream, rules).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(sessions.CLOSED.format(session="long")).parquet(f"{tmp_path}/out").collect()))
    assert batch and got == batch and all(r[5] >= 10 for r in got)


def test_frames_to_points(spark):
    hand = [{"x": 0.25, "y": 0.5, "z": 0.0} for _ in range(21)]
    for tip, y in ((8, 0.2), (12, 0.9), (16, 0.9), (20, 0.9)):
        hand[tip] = {"x": 0.25, "y": y, "z": 0.0}
    rows = [("s", k, f"2026-01-01 00:00:0{k}", 640, 480, None, hand if k != 1 else None) for k in range(3)]
    df = spark.createDataFrame(rows, "session_id string, frame_idx bigint, ts string, frame_w int, frame_h int, handedness string, landmarks array<struct<x:double,y:double,z:double>>")
    got = R.pen_frames(df.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy("frame_idx").collect()
    assert [r.gesture for r in got] == ["Draw", "Pen up", "Draw"] and got[0].p == 0.75 and got[0].q == pytest.approx(0.2) and got[1].p is None
    assert R.skeleton_segments(df, "frame_idx").count() == 46


def test_fences(spark):
    chunks = spark.createDataFrame([("a", 1, 0, bytearray(b"x")), ("a", 2, 0, bytearray(b"y")), ("a", 2, 1, bytearray())], "session_id string, recorder int, chunk_idx int, data binary")
    now = spark.createDataFrame([("a", 2)], "session_id string, recorder int")
    assert [bytes(r.data) for r in R.live_chunks(chunks, now).collect()] == [b"y"]


def test_metadata_document(spark):
    points = [(0, 0.1, 0.2, 1), (1, 0.3, 0.2, 1)]
    from strokeloom.operators.samples import collect_samples

    samples = collect_samples(spark.createDataFrame([("s", *p) for p in points], "sample_id string, idx int, p double, q double, stroke_id int"), ["sample_id"])
    full = samples.withColumns({"username": F.lit("  "), "label": F.lit("A"), "created_at": now(), "auto_saved": F.lit(True), "user_agent": F.lit("x")})
    full = full.withColumn("media", F.struct(F.lit("s.png").alias("image"), F.lit(None).cast("string").alias("video"), F.lit(None).cast("string").alias("video_mime")))
    m = metadata_document(full, IngestRules(), CaptureRules()).first().metadata
    assert m.username == "user1" and m.label == "অ" and m.trajectory.num_points == 2 and m.trajectory.features_8d[1][0] == 0.2 and m.frame_size == [640, 480]


def test_sessions_of_any_key(spark):
    rows = [(s, k * 100_000, k, "Draw", "") for s in ("a", "b", None) for k in range(12)] + [("b", 10_000_000, 99, "Pen up", "")]
    df = spark.createDataFrame(rows, "session_id string, us long, seq long, action string, outcome string")
    got = {r.session_id: (r.num_points, r.reason) for r in sessions.fold(df, CaptureRules()).collect()}
    assert got == {"a": (12, "open"), "b": (12, "pause"), None: (12, "open")}
    big = (1 << 60) + 1
    ids = spark.createDataFrame([(big, 0, 0, "Draw", ""), (None, 0, 0, "Draw", "")], "session_id long, us long, seq long, action string, outcome string")
    assert {r.session_id for r in sessions.follow(ids, CaptureRules()).collect()} == {big, None}


ROW = "username string, label string, path string, content binary"


def test_torn_manifests_are_passed_over(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("u", "l", "p1", bytearray(b"a"))], ROW)
    assert store.commit(rows, "one") == 1
    for version, text in ((2, ""), (3, '{"parts": ["par'), (4, "[]")):
        (tmp_path / f"s/manifests/{version:012d}.json").write_text(text)
    assert store.head()[0] == 4 and [bytes(r.content) for r in store.read().collect()] == [b"a"]
    assert store.commit(rows.withColumn("content", F.lit(b"b")), "five") == 5
    assert [bytes(r.content) for r in store.read().collect()] == [b"b"]
    assert not store._create(5, {"parts": []}) and not [p for p in (tmp_path / "s/manifests").iterdir() if p.name.startswith(".0") and not p.name.endswith(".crc")]


def test_missing_store(spark, tmp_path):
    from strokeloom.sources.sink import MissingStore

    with pytest.raises(MissingStore) as told:
        SampleStore(spark, f"file://{tmp_path}/none", create=False)
    assert told.value.status == 400
    assert SampleStore(spark, f"file://{tmp_path}/none").read().count() == 0


def test_many_commits_are_one_scan_and_compact(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("u", "l", f"p{k}", bytearray(b"first")) for k in range(5)], ROW)
    store.commit(rows, "all", "stream:0")
    for k in range(1, 12):
        one = spark.createDataFrame([("u" if k % 2 else "v", "l", f"p{k % 6}", bytearray(str(k).encode()))], ROW).coalesce(1)
        store.commit(one, "one", f"stream:{k}")
    want = {"p0": b"6", "p1": b"7", "p2": b"8", "p3": b"9", "p4": b"10", "p5": b"11"}
    held = lambda: {r.path: bytes(r.content) for r in store.read().collect()}
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert held() == want and plan.count("Relation [") == 1
    before = store.head()
    assert store.commit(rows, "again", "stream:7") == before[0] and store.head() == before
    store.compact()
    assert len(store.head()[1]["parts"]) == 1 and store.head()[1]["batches"] == {"stream": 11} and held() == want


def test_chunks_on_a_stream_with_late_ones(spark, tmp_path):
    from strokeloom.streaming.sessions import media_slices

    schema = "session_id long, ts timestamp, data binary"
    at = lambda ms: f"2026-01-01 00:00:{ms / 1000:06.3f}"
    batches = [[(1, at(0)), (1, at(100)), (1, at(300))], [(1, at(240)), (1, at(900))], [(1, at(2000))], [(1, at(10)), (1, at(5000))]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(s, t, bytearray(b"xy")) for s, t in rows], "session_id long, ts string, data binary")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    query = media_slices(stream).select("session_id", F.unix_millis("slice.start").alias("ms"), "chunks", "bytes").writeStream.format("parquet")
    query.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("session_id long, ms long, chunks long, bytes long").parquet(f"{tmp_path}/out").collect()
    base = min(r.ms for r in got)
    found = {r.ms - base: (r.chunks, r.bytes) for r in got}
    assert found[0] == (3, 6) and found[250] == (1, 2) and found[750] == (1, 2)  # 240 ms came in time, 10 ms too late


def test_odd_bodies_and_repeated_keys(spark):
    row = built(spark, '{"image":{"dataUrl":"data:image/png;base64,TWFu"},"metadata":{"a":1,"a":{"x":1,"x":2},"label":"ঔ"},"sampleId":"s"}').first()
    assert row.status is None and json.loads(row.metadata)["a"] == {"x": 2} and row.label == "ঔ"
    assert built(spark, {"image": PNG, "video": "none"}).first().status is None
    df = spark.createDataFrame([("{} x",), ("{'a': 1}",), ("{},{}",), ('{"a":1}\n',), ('"{}"',), ("null",)], "body string")
    assert [r.body_status for r in tables.parse_requests(df).collect()] == [400, 400, 400, None, 400, 400]


def test_header_key_counts_first(spark):
    rules = IngestRules(upload_key="k")
    rows = [(json.dumps({"image": PNG, "uploadKey": body}), "s", header) for body, header in (("k", None), ("k", ""), ("x", "k"), ("k", "x"))]
    df = spark.createDataFrame(rows, "body string, seed string, header_key string")
    assert [r.status for r in ingest.build_sample_files(tables.parse_requests(df), rules, now()).collect()] == [None, None, None, 401]
    with pytest.raises(ValueError):
        tables.checked_rules("a/b")


def test_frames_as_files_and_as_a_stream(spark, tmp_path):
    hand = [{"x": 0.5, "y": 0.5, "z": 0.0}] * 21
    hands = spark.createDataFrame([("s", 0, [hand, hand]), ("s", 1, [])], "session_id string, frame_idx bigint, hands array<array<struct<x:double,y:double,z:double>>>")
    rows = hands.select("session_id", "frame_idx", F.lit(0).cast("timestamp").alias("ts"), F.lit(640).alias("frame_w"), F.lit(480).alias("frame_h"), F.lit("Left").alias("handedness"), R.first_hand(F.col("hands")).alias("landmarks"))
    rows.write.parquet(f"{tmp_path}/frames")
    read = tables.read_frames(spark, f"{tmp_path}/frames")
    assert [r.landmarks is None for r in read.orderBy("frame_idx").collect()] == [False, True] and R.pen_frames(read).where("down").count() == 0
    query = R.pen_frames(tables.read_frames(spark, f"{tmp_path}/frames", streaming=True)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks")
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    (tmp_path / "lines.json").write_text('{"username": "a"}\n{oops\n')
    assert [(r.request.username, r.body_status) for r in tables.read_requests(spark, f"{tmp_path}/lines.json").collect()] == [("a", None), (None, 400)]


def test_a_clear_aborts_a_save_and_a_late_outcome_is_a_failure(spark):
    schema = "session_id long, us long, seq long, action string"
    s = 1_000_000
    frames = [(k, s // 10 * j, j, "Draw") for k in range(4) for j in range(12)] + [(k, 100 * s, 50, "Draw") for k in range(4)]
    controls = [(k, 2 * s, 20, "save") for k in range(4)]
    controls += [(0, 3 * s, 21, "save_ok"), (1, 3 * s, 21, "save_failed"), (2, 3 * s, 21, "clear"), (3, 90 * s, 21, "save_ok")]
    rows = sessions.with_controls(spark.createDataFrame(frames, schema), spark.createDataFrame(controls, schema), CaptureRules())
    got = sorted((r.session_id, r.sample, r.num_points, r.reason) for r in sessions.fold(rows, CaptureRules()).collect())
    assert got == [(0, 0, 12, "manual"), (0, 1, 1, "open"), (1, 0, 13, "cap"), (2, 0, 1, "open"), (3, 0, 13, "cap")]
