"""Queries on scalar rules, requests, metadata and stores, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom.functions import scalar as S
from strokeloom.operators import ingest
from strokeloom.operators.samples import join_chunks
from strokeloom.params import CODECS, LABELS, IngestRules
from strokeloom.shared import new_folder
from strokeloom.sources import tables
from strokeloom.sources.sink import SampleStore
from strokeloom.streaming.sessions import slices

RULES = IngestRules()
CAP = 3000
NOW = "2026-01-02 03:04:05.678"
MIMES = ("image/png", "video/webm;codecs=vp9", "text/plain", "image/jpeg")


def _key_sql(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(nfc_normalize({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}.-]+', '_', 'g'), '_'), ''), 'x')"


def key_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_name", F.lit("__"), "p_brand", F.lit("/../ "), F.substring("p_type", 1, 5))
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", S.safe_key(F.col("raw"), compose=True).alias("composed"), S.safe_key(F.col("raw")).alias("safe"))


def sample_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, label, name = S.safe_key(F.col("c_name")), S.safe_key(F.col("c_mktsegment")), F.col("c_custkey").cast("string")
    folder = S.join_path(S.trim_slashes(F.lit("/output/")), user, label, F.lit(""))
    declared = F.when(F.col("c_custkey") % 3 == 0, F.lit("MP4")).when(F.col("c_custkey") % 3 == 1, F.lit("avi"))
    mime = F.when(F.col("c_custkey") % 2 == 0, F.lit("video/mp4;codecs=x"))
    rows = tables.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", ingest.media_path(folder, F.concat_ws("_", label, name), S.choose_extension(declared, mime)).alias("path"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("doc_id") % 4 + 1).cast("int"))
    comma = F.when(F.col("doc_id") % 7 == 0, F.lit(";")).otherwise(F.lit(","))
    url = F.concat(F.lit("data:"), mime, F.lit(";base64"), comma, F.base64(F.col("text").cast("binary")))
    docs = tables.dealt(tables.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", url.alias("url"), F.octet_length("text").alias("bytes"))


def dataurl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.settled(_urls(spark, sf_dir).withColumn("parsed", S.parse_data_url(F.col("url"))))
    parsed = F.col("parsed")
    return rows.select(
        "doc_id", parsed["mime"].alias("mime"), F.length(parsed["payload"]).cast("long").alias("payload_chars"),
        S.decoded_length(parsed["payload"]).cast("long").alias("n_bytes"),
        S.data_url_fault(F.col("url"), "image/", parsed).alias("image_fault"), S.data_url_fault(F.col("url"), "video/", parsed).alias("video_fault"),
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as JSON bodies: the text is the image of even ids and the video of odd ones."""
    media = F.struct(F.col("url").alias("dataUrl"))
    body = F.to_json(F.struct(
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" user "), "source")).alias("username"),
        F.when(F.col("doc_id") % 3 != 0, F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 11 + 1).cast("int"))).alias("label"),
        F.col("doc_id").cast("string").alias("sampleId"), F.lit("2026-01-01T00:00:00.000Z").alias("createdAt"),
        F.when(F.col("doc_id") % 2 == 0, media).alias("image"), F.when(F.col("doc_id") % 2 == 1, media).alias("video"),
        F.struct(F.lit("meta").alias("username"), F.col("doc_id").alias("extra"), F.array(F.lit(1), F.lit(2)).alias("list")).alias("metadata"),
    ))
    broken = F.when(F.col("doc_id") % 31 == 0, F.lit("{oops")).otherwise(body)
    return _urls(spark, sf_dir).select("doc_id", broken.alias("body"), F.col("doc_id").cast("string").alias("seed"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.build_sample_files(tables.parse_requests(_requests(spark, sf_dir)), RULES, F.lit(NOW).cast("timestamp"))


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, paths and merged metadata of every request, also of bodies that are no JSON."""
    built = tables.settled(_built(spark, sf_dir).withColumn("_meta", F.try_parse_json(F.when(F.col("status").isNull(), F.col("metadata")))))
    said = lambda k, kind="string": F.try_variant_get("_meta", f"$.{k}", kind)
    outcome = {
        **{c: F.col(c) for c in ("username", "label", "image_path", "video_path", "json_path", "message")},
        "meta_username": said("username"), "meta_extra": said("extra", "long"), "meta_created_at": said("created_at"), "meta_path": said("repository.paths.json"),
        "n_files": (F.lit(1) + F.col("image_path").isNotNull().cast("int") + F.col("video_path").isNotNull().cast("int")).cast("long"),
    }
    return built.select("doc_id", "status", *(F.when(F.col("status").isNull(), c).alias(k) for k, c in outcome.items()))


ODD_RULES = IngestRules(upload_key="k1", max_bytes=6000)


def _odd_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as bodies of thirteen kinds, most of them odd: a key twice, text after the object,
    single quotes, wrong types, both media or none, too large, keys beside the body and in it."""
    text = F.regexp_replace(F.substring("text", 1, 5000), "[^A-Za-z ]", "")
    media = lambda mime, more="", text=text: F.concat(F.lit(f'{{"dataUrl":"data:{mime};base64,'), F.regexp_replace(F.base64(text.cast("binary")), r"\s", ""), F.lit(f'"{more}}}'))
    image = media("image/png")
    large = F.rpad(text, F.when(F.col("doc_id") % 2 == 0, 4000).otherwise(1000), "x")
    body = lambda *parts: F.concat(F.lit('{"username":"u","label":"ঔ","sampleId":"'), F.col("doc_id").cast("string"), F.lit('"'), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    own = ',"uploadKey":"k1"}'
    kinds = (
        body(',"image":', image, ',"metadata":{"a":1,"a":2,"b":{"c":[1],"c":3}}', own),
        F.concat(body(',"image":', image, own), F.lit(" and more")),
        F.translate(body(',"image":', image, own), '"', "'"),
        body(',"image":', image, ',"video":"none"', own),
        body(',"image":', media("image/png", text=large), ',"video":', media("video/mp4;codecs=x", text=large), own),
        body(own),
        body(',"video":', media("video/webm", ',"extension":"MP4"'), own),
        body(',"image":', image, ',"uploadKey":"k2"}'),
        body(',"image":', image, ',"uploadKey":"k2"}'),
        F.lit("[1, 2]"),
        body(',"image":', image, ',"metadata":[1,2]', own),
        F.concat(body(',"image":', image, own), F.lit(","), body(own)),
        F.concat(F.lit(" \n"), body(',"image":{"dataUrl":"data:image/png;base64,"}', own)),
    )
    kind = F.col("doc_id") % len(kinds)
    chosen = F.lit(None).cast("string")
    for k, made in enumerate(kinds):
        chosen = F.when(kind == k, made).otherwise(chosen)
    header = F.when(kind == 8, F.lit("k1")).when(kind == 0, F.lit(""))
    docs = tables.dealt(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", kind.alias("kind"), chosen.alias("body"), F.col("doc_id").cast("string").alias("seed"), header.alias("header_key"))


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status, files and metadata for every body, however odd."""
    parsed = tables.parse_requests(_odd_bodies(spark, sf_dir), max_body=9000)
    built = ingest.build_sample_files(parsed, ODD_RULES, F.lit(NOW).cast("timestamp"))
    kept = F.filter("files", lambda f: ~F.endswith(f["path"], F.lit(".json")))
    said = lambda k: F.when(F.col("status").isNull(), F.get_json_object("metadata", f"$.{k}"))
    return built.select(
        "doc_id", "kind", F.coalesce("status", F.lit(200)).alias("status"),
        F.when(F.col("status").isNull(), F.array_join(F.transform(kept, lambda f: F.substring_index(f["path"], ".", -1)), " ")).alias("media"), said("a").alias("a"), said("b.c").alias("c"),
    )


def byte_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the media alone; the document's own length is no contract."""
    kept = F.filter("files", lambda f: ~F.endswith(f["path"], F.lit(".json")))
    return _built(spark, sf_dir).where("status is null").select(
        "doc_id", F.aggregate(kept, F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f["content"])).alias("media_bytes")
    )


def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.octet_length("text").cast("long")
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", total.alias("total_bytes"))
    cap = ingest.over_cap(F.col("total_bytes"), CAP)
    return rows.select("doc_id", "total_bytes", cap.alias("status"), S.megabytes(F.col("total_bytes") * 1000).alias("megabytes"))


def status_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 + 200).cast("int").alias("status"))
    return rows.select("o_orderkey", S.status_for(F.col("status")).alias("status"), F.col("status").isin(409, 422).alias("retried"))


def iso_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", S.iso_text(F.col("ts").cast("timestamp")).alias("iso"))


def sample_id_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return tables.table(spark, sf_dir, "events").select("event_id", S.stamp(ts).alias("stamp"), S.pad2(F.col("event_id")).alias("padded"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*LABELS, "A", "", "ক")
    return tables.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("label"))


def label_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("event_id", S.label_in_domain(F.col("label"), LABELS).alias("label"))


def label_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = spark.createDataFrame([(x,) for x in LABELS], "label string")
    return _labelled(spark, sf_dir).join(F.broadcast(domain), "label", "left_semi").select("event_id", "label")  # 11 rows


def _sometimes(value: Column) -> Column:
    k = F.col("turn") % 4
    return F.when(k == 0, F.lit("")).when(k == 1, F.lit(" \t ")).when(k == 2, F.concat(F.lit("  "), value, F.lit(" ﻿")))


def falsy_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _sometimes(F.col("role"))
    return tables.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", S.username_or_default(name).alias("username"), S.safe_key(S.first_given(name, F.lit("anonymous"))).alias("key"),
        S.blank_to_null(name).isNull().alias("falsy"),
    )


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' props with a name on top: unknown keys survive, overrides win."""
    user = ingest.as_variant(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    given = F.concat(F.lit('{"username": "older", "username": "old", "own": [1, "x"], '), F.substring("props", 2, 1000))
    merged = F.to_json(ingest.merge_metadata(ingest.metadata_object(given), {"username": user, "label": ingest.as_variant(F.lit("ঔ"))}))
    rows = tables.table(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    got = lambda k: F.get_json_object("m", f"$.{k}")
    return rows.select("event_id", got("k").cast("long").alias("k"), got("username").alias("username"), got("label").alias("label"), got("own[1]").alias("own"))


def upsert_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("output/"), "c_name").alias("path"), F.col("c_acctbal").alias("value"))
    new = tables.table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("output/"), "c_name").alias("path"), F.lit(-1.0).alias("value"))
    more = new.limit(0).unionByName(spark.createDataFrame([("output/new", 1.5)], "path string, value double"))
    return ingest.upsert(base, new.unionByName(more))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits to a fresh store, the second over a part of the first, and what it then holds."""
    rows = tables.table(spark, sf_dir, "customer").select(
        S.safe_path_key(F.col("c_mktsegment")).alias("username"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("label"),
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").cast("binary").alias("content"), "c_custkey",
    )
    store = SampleStore(spark, new_folder(spark, "store"))
    store.commit(rows, "all", batch="0")
    store.commit(rows.where("c_custkey % 10 = 0").withColumn("content", F.lit("again").cast("binary")), "some", batch="1")
    store.commit(rows, "a batch that came before", batch="0")
    return store.read().select("username", "label", "path", F.col("content").cast("string").alias("content"))


def codec_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    able = F.filter(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for k, m in enumerate(CODECS))), lambda c: F.col("n_nationkey").bitwiseAND(F.pow(F.lit(2), c["k"]).cast("int")) > 0)
    rows = tables.table(spark, sf_dir, "nation").withColumn("able", F.transform(able, lambda c: c["m"]))
    return rows.select("n_nationkey", S.first_supported(CODECS, F.col("able")).alias("codec"))


def chunk_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into slices of 100 bytes, dealt out, and joined again in order."""
    data = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / 100).cast("int"))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", data.alias("data"), F.posexplode(starts).alias("chunk_idx", "at"))
    chunks = docs.select("doc_id", "chunk_idx", F.substring("data", F.col("at") * 100 + 1, F.lit(100)).alias("data"))
    return join_chunks(chunks, ["doc_id"]).select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text and its number as the two files of a sample."""
    files = F.array(
        F.struct(F.lit("a.txt").alias("path"), F.col("text").cast("binary").alias("content")),
        F.struct(F.lit("a.json").alias("path"), F.col("doc_id").cast("string").cast("binary").alias("content")),
    )
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.inline(ingest.file_hashes(files)))
    return rows


def tumbling_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("data"))
    return slices(rows, "1 day").select("session_id", F.unix_micros("slice.start").alias("from_us"), "chunks", "bytes")


def settings_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", _sometimes(F.col("role")).alias("username"), F.when(F.col("turn") % 2 == 0, F.lit(LABELS[2])).alias("label"),
        F.when(F.col("turn") % 3 == 0, F.lit("k")).alias("upload_key"),
    )
    return tables.settings(rows.withColumn("username", S.trim_wide(F.col("username"))))


def repo_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.lit("own")), F.lit("/"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand")))
    return tables.table(spark, sf_dir, "part").select("p_partkey", ingest.repo_ok(name).alias("ok"))


def response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every sender is told once the files are committed."""
    built = _built(spark, sf_dir)
    store = SampleStore(spark, new_folder(spark, "responses"))
    version = store.commit(ingest.file_rows(built), "Add samples")
    told = ingest.response(built, version, "manifests/")
    return told.select(F.col("seed").cast("long").alias("doc_id"), "sample_id", "ok", "status", F.array_join("paths", " ").alias("paths"), "commit", "commit_url")


def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: documents by source and language, with subtotals."""
    rows = tables.table(spark, sf_dir, "documents").rollup("source", "lang")
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.sum("n_chars").alias("chars"))


_URLS_SQL = f"""
urls AS (SELECT doc_id, source, text, ['{"', '".join(MIMES)}'][doc_id % 4 + 1] AS mime, doc_id % 7 <> 0 AS well, strlen(text) AS bytes FROM documents)"""
_LABELS_SQL = "['" + "', '".join(LABELS) + "']"

_INGEST_SQL = f"""
named AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'meta' ELSE {_key_sql("' user ' || source")} END AS username,
    CASE WHEN doc_id % 3 <> 0 THEN {_LABELS_SQL}[doc_id % 11 + 1] ELSE 'unknown' END AS label FROM urls WHERE doc_id % 31 <> 0),
based AS (SELECT *, 'output/' || username || '/' || label || '/' || label || '_' || doc_id AS base,
    well AND doc_id % 2 = 0 AS has_image, well AND doc_id % 2 = 1 AS has_video FROM named),
judged AS (SELECT *, CASE WHEN NOT well THEN 400 WHEN doc_id % 2 = 0 AND NOT starts_with(mime, 'image/') THEN 400
    WHEN doc_id % 2 = 1 AND NOT starts_with(mime, 'video/') THEN 400 END AS fault FROM based)"""

QUERIES = {
    f.__name__: f
    for f in (
        key_sanitise, sample_paths, dataurl_parse, ingest_requests, byte_sums, size_cap, status_pass_through, iso_stamp, sample_id_stamp, label_domain,
        label_semi_join, falsy_defaults, metadata_merge, upsert_by_path, store_round_trip, codec_preference, chunk_concat, sample_statistics,
        file_hashes, tumbling_slices, settings_defaults, repo_shape, response_projection, odd_requests,
    )
}

_CODEC_SQL = " ".join(f"WHEN n_nationkey & {2**k} > 0 THEN '{m}'" for k, m in enumerate(CODECS))
_NAMES_SQL = "['" + "', '".join((*LABELS, "A", "", "ক")) + "']"

ORACLE_SQL = {
    "key_sanitise": f"""WITH r AS (SELECT p_partkey, ' ' || p_name || '__' || p_brand || '/../ ' || substring(p_type, 1, 5) AS raw FROM part)
        SELECT p_partkey, {_key_sql("raw")} AS composed, {_key_sql("raw")} AS safe FROM r""",
    "sample_paths": f"""SELECT c_custkey, 'output/' || {_key_sql("c_name")} || '/' || {_key_sql("c_mktsegment")} || '/' || {_key_sql("c_mktsegment")} || '_' || c_custkey || '.' ||
        CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND c_custkey % 2 = 0) THEN 'mp4' ELSE 'webm' END AS path FROM customer""",
    "dataurl_parse": f"""WITH {_URLS_SQL} SELECT doc_id, CASE WHEN well AND bytes > 0 THEN mime END AS mime,
        CASE WHEN well AND bytes > 0 THEN ((bytes + 2) // 3 * 4)::BIGINT END AS payload_chars, CASE WHEN well AND bytes > 0 THEN bytes::BIGINT END AS n_bytes,
        CASE WHEN NOT (well AND bytes > 0 AND starts_with(mime, 'image/')) THEN 400 END AS image_fault,
        CASE WHEN NOT (well AND bytes > 0 AND starts_with(mime, 'video/')) THEN 400 END AS video_fault FROM urls""",
    "ingest_requests": f"""WITH {_URLS_SQL}, {_INGEST_SQL}, ok AS (SELECT * FROM judged WHERE fault IS NULL)
        SELECT doc_id, NULL::INTEGER AS status, username, label, CASE WHEN doc_id % 2 = 0 THEN base || '.png' END AS image_path,
          CASE WHEN doc_id % 2 = 1 THEN base || '.webm' END AS video_path, base || '.json' AS json_path, 'Add sample ' || username || '/' || label || '/' || doc_id AS message,
          username AS meta_username, doc_id AS meta_extra, '2026-01-01T00:00:00.000Z' AS meta_created_at, base || '.json' AS meta_path, 2::BIGINT AS n_files FROM ok
        UNION ALL SELECT doc_id, coalesce(fault, 400), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM urls LEFT JOIN judged USING (doc_id)
        WHERE doc_id % 31 = 0 OR fault IS NOT NULL""",
    "byte_sums": f"WITH {_URLS_SQL}, {_INGEST_SQL} SELECT doc_id, bytes::BIGINT AS media_bytes FROM judged WHERE fault IS NULL",
    "size_cap": f"""SELECT doc_id, strlen(text)::BIGINT AS total_bytes, CASE WHEN strlen(text) > {CAP} THEN 413 END AS status,
        floor(strlen(text)::BIGINT * 1000 / (1024 * 1024) + 0.5)::BIGINT AS megabytes FROM documents""",
    "status_pass_through": "WITH s AS (SELECT o_orderkey, (o_orderkey % 400 + 200)::INTEGER AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 500 THEN s ELSE 500 END AS status, s IN (409, 422) AS retried FROM s",
    "iso_stamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events",
    "sample_id_stamp": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CASE WHEN event_id < 10 THEN '0' ELSE '' END || event_id AS padded FROM events",
    "label_domain": f"WITH l AS (SELECT event_id, {_NAMES_SQL}[event_id % 14 + 1] AS label FROM events) SELECT event_id, CASE WHEN list_contains({_LABELS_SQL}, label) THEN label ELSE '{LABELS[0]}' END AS label FROM l",
    "label_semi_join": f"WITH l AS (SELECT event_id, {_NAMES_SQL}[event_id % 14 + 1] AS label FROM events) SELECT event_id, label FROM l WHERE label IN (SELECT unnest({_LABELS_SQL}))",
    "falsy_defaults": """SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN role ELSE 'user1' END AS username,
        CASE turn % 4 WHEN 2 THEN role WHEN 1 THEN 'x' ELSE 'anonymous' END AS key, turn % 4 IN (0, 3) AS falsy FROM conversations""",
    "metadata_merge": """SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k, 'u' || user_id AS username, 'ঔ' AS label, 'x' AS own FROM events""",
    "upsert_by_path": """SELECT 'output/' || c_name AS path, CASE WHEN c_custkey % 7 = 0 THEN -1.0 ELSE c_acctbal END AS value FROM customer UNION ALL SELECT 'output/new', 1.5""",
    "store_round_trip": f"""SELECT {_key_sql("c_mktsegment")} AS username, 'n' || c_nationkey AS label, 'p' || c_custkey AS path, CASE WHEN c_custkey % 10 = 0 THEN 'again' ELSE c_name END AS content FROM customer""",
    "codec_preference": f"SELECT n_nationkey, CASE {_CODEC_SQL} ELSE '' END AS codec FROM nation",
    "chunk_concat": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, md5(text) AS md5 FROM documents",
    "file_hashes": "SELECT doc_id, 'a.txt' AS path, sha1(text) AS sha FROM documents UNION ALL SELECT doc_id, 'a.json', sha1(doc_id::VARCHAR) FROM documents",
    "tumbling_slices": "SELECT user_id AS session_id, epoch_us(date_trunc('day', ts)) AS from_us, count(*) AS chunks, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY ALL",
    "settings_defaults": f"""SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN role ELSE 'user1' END AS username, CASE WHEN turn % 2 = 0 THEN '{LABELS[2]}' ELSE '{LABELS[0]}' END AS label,
        CASE WHEN turn % 3 = 0 THEN 'k' ELSE '' END AS upload_key FROM conversations""",
    "repo_shape": "SELECT p_partkey, regexp_full_match(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'own' END || '/' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END, '[^/\\s]+/[^/\\s]+') AS ok FROM part",
    "response_projection": f"""WITH {_URLS_SQL}, {_INGEST_SQL}, told AS (SELECT doc_id, base, CASE WHEN doc_id % 31 = 0 THEN 400 ELSE coalesce(fault, 200) END AS status FROM urls LEFT JOIN judged USING (doc_id))
        SELECT doc_id, CASE WHEN status = 200 THEN doc_id::VARCHAR END AS sample_id, status = 200 AS ok, status, CASE WHEN status = 200 THEN '000000000001' END AS commit,
        CASE WHEN status = 200 THEN 'manifests/000000000001.json' END AS commit_url,
        CASE WHEN status = 200 THEN base || CASE WHEN doc_id % 2 = 0 THEN '.png ' ELSE '.webm ' END || base || '.json' END AS paths FROM told""",
    "odd_requests": """WITH d AS (SELECT doc_id, doc_id % 13 AS kind, strlen(regexp_replace(substring(text, 1, 5000), '[^A-Za-z ]', '', 'g')) AS n FROM documents),
        judged AS (SELECT *, CASE WHEN kind IN (1, 2, 5, 9, 11, 12) OR (n = 0 AND kind NOT IN (4, 7)) THEN 400 WHEN kind = 7 THEN 401 WHEN kind = 4 AND doc_id % 2 = 0 THEN 413 ELSE 200 END AS status FROM d)
        SELECT doc_id, kind, status, CASE WHEN status = 200 THEN CASE kind WHEN 4 THEN 'png mp4' WHEN 6 THEN 'mp4' ELSE 'png' END END AS media,
          CASE WHEN status = 200 AND kind = 0 THEN '2' END AS a, CASE WHEN status = 200 AND kind = 0 THEN '3' END AS c FROM judged""",
    "sample_statistics": "SELECT source, lang, count(*) AS samples, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)",
}
