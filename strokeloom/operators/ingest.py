"""Upload requests to files: validation, media, paths, merged metadata, size cap, rejects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strokeloom.functions import scalar as S
from strokeloom.params import IngestRules
from strokeloom.sources.tables import settled

OVERRIDES = ("username", "label", "sample_id", "created_at", "repository", "uploaded_at")


def media_path(base: Column, name: Column, extension: Column | str) -> Column:
    extension = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat(base, F.lit("/"), name, F.lit("."), extension)


@F.pandas_udf(T.StringType())
def _last_of_each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON objects that name a key twice, with the last value of each; null for other texts."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    for s in texts:
        yield s.map(one)


def metadata_object(given: Column) -> Column:
    """The caller's object as a variant; null for null and for what is no object. Of a key that comes
    twice the last value counts: only such objects, rare ones, leave the JVM."""
    strict = F.try_parse_json(given)
    again = F.try_parse_json(_last_of_each(F.when(strict.isNull(), given)))
    return F.when(F.startswith(F.ltrim(given), F.lit("{")), F.coalesce(strict, again))


def merge_metadata(given: Column, overrides: dict[str, Column]) -> Column:
    """given: of metadata_object. A map of the caller's keys with overrides on top; keys nobody knows survive."""
    caller = F.coalesce(F.try_variant_get(given, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(caller, lambda k, v: ~k.isin(*overrides))
    mine = F.create_map(*(x for k, v in overrides.items() for x in (F.lit(k), v)))
    return F.map_concat(others, mine)


def as_variant(value: Column) -> Column:
    return value.cast("variant")


def build_sample_files(requests: DataFrame, rules: IngestRules, now: Column) -> DataFrame:
    """requests: (request, seed[, body_status, header_key], ...), seed naming an id for requests without
    one, header_key the key that came beside the body and counts before the body's.

    Adds username, label, sample_id, image and video (mime, payload), image_path, video_path,
    json_path, metadata (JSON text), files, total_bytes, message and status: null if all is well,
    else the body's status, 401, 400 or 413. A request with a status has no files.
    """
    r = F.col("request")
    header = F.col("header_key") if "header_key" in requests.columns else F.lit(None).cast("string")
    body_status = F.col("body_status") if "body_status" in requests.columns else F.lit(None).cast("int")
    given = settled(requests.withColumn("_given", metadata_object(r["metadata"])))
    said = lambda k: F.try_variant_get(F.col("_given"), f"$.{k}", "string")
    # Keys may be in decomposed Unicode: of all rows, only three short columns leave the JVM.
    named = given.withColumns({
        "username": S.safe_key(S.first_given(r["username"], said("username"), F.lit("anonymous")), compose=True),
        "label": S.safe_key(S.first_given(r["label"], said("label"), F.lit("unknown")), compose=True),
        "sample_id": S.safe_key(S.first_given(r["sampleId"], S.sample_id(now, F.col("seed"))), compose=True),
        "image": S.parse_data_url(r["image"]["dataUrl"]),
        "video": S.parse_data_url(r["video"]["dataUrl"]),
    })
    folder = S.join_path(S.blank_to_null(S.trim_slashes(F.lit(rules.output_dir))), F.col("username"), F.col("label"))
    name = F.concat_ws("_", "label", "sample_id")
    image, video = F.col("image"), F.col("video")
    extension = S.choose_extension(r["video"]["extension"], video["mime"])
    placed = settled(named).withColumns({
        "image_path": F.when(image.isNotNull(), media_path(folder, name, "png")),
        "video_path": F.when(video.isNotNull(), media_path(folder, name, extension)),
        "json_path": media_path(folder, name, "json"),
    })
    paths = F.struct(F.col("image_path").alias("image"), F.col("video_path").alias("video"), F.col("json_path").alias("json"))
    repository = F.struct(F.lit(rules.repo).alias("repo"), F.lit(rules.branch).alias("branch"), paths.alias("paths"))
    overrides = {
        "username": as_variant(F.col("username")),
        "label": as_variant(F.col("label")),
        "sample_id": as_variant(F.col("sample_id")),
        "created_at": as_variant(S.first_given(r["createdAt"], said("created_at"), S.iso_text(now))),
        "repository": F.to_variant_object(repository),
        "uploaded_at": as_variant(S.iso_text(now)),
    }
    merged = placed.withColumn("metadata", F.to_json(merge_metadata(F.col("_given"), overrides), {"pretty": "true"})).drop("_given")
    entry = lambda path, content: F.when(path.isNotNull(), F.struct(path.alias("path"), content.alias("content")))
    files = F.array(
        entry(F.col("image_path"), F.unbase64(image["payload"])),
        entry(F.col("video_path"), F.unbase64(video["payload"])),
        entry(F.col("json_path"), F.encode("metadata", "UTF-8")),
    )
    total = F.coalesce(S.decoded_length(image["payload"]), F.lit(0)) + F.coalesce(S.decoded_length(video["payload"]), F.lit(0)) + F.octet_length("metadata")
    key = S.first_given(header, r["uploadKey"])
    fault = F.coalesce(
        body_status,
        F.when(F.lit(bool(rules.upload_key)) & ~F.coalesce(key == rules.upload_key, F.lit(False)), F.lit(401)),
        S.data_url_fault(r["image"]["dataUrl"], "image/", image),
        S.data_url_fault(r["video"]["dataUrl"], "video/", video),
        F.when(image.isNull() & video.isNull(), F.lit(400)),
        # A folder named . or .. would leave the tree.
        F.when(F.col("username").isin(".", "..") | F.col("label").isin(".", ".."), F.lit(400)),
    )
    sized = settled(merged).withColumn("total_bytes", total.cast("long")).withColumn("status", F.coalesce(fault, over_cap(F.col("total_bytes"), rules.max_bytes)))
    return settled(sized).withColumns({
        "files": F.when(F.col("status").isNull(), F.filter(files, lambda x: x.isNotNull())),
        "message": F.format_string(rules.message, "username", "label", "sample_id"),
    })


def over_cap(total: Column, most: int) -> Column:
    return F.when(total > most, F.lit(413))


def response(built: DataFrame, version: int | None = None, address: str = "") -> DataFrame:
    """What every sender is told, those of refused requests, too: all columns of built that name a
    request, ok, status, message, paths, and of files that were committed the version and its address."""
    ok = F.col("status").isNull()
    commit = F.when(ok & F.lit(version is not None), F.lit("" if version is None else f"{version:012d}"))
    return built.select(
        "seed", F.when(ok, F.col("sample_id")).alias("sample_id"), ok.alias("ok"), F.coalesce("status", F.lit(200)).alias("status"), F.when(ok, F.col("message")).alias("message"),
        F.transform("files", lambda f: f["path"]).alias("paths"), commit.alias("commit"), F.concat(F.lit(address), commit, F.lit(".json")).alias("commit_url"),
    )


def file_rows(built: DataFrame) -> DataFrame:
    """The files of requests without a status, as a store takes them."""
    return built.where("status is null").select("username", "label", F.explode("files").alias("f")).select("username", "label", "f.path", "f.content")


def file_hashes(files: Column) -> Column:
    """Each file's path with its content's hash, in place."""
    return F.transform(files, lambda f: F.struct(f["path"].alias("path"), F.sha1(f["content"]).alias("sha")))


def repo_ok(repo: Column) -> Column:
    """owner/name, neither empty, without white space."""
    return F.coalesce(repo.rlike(r"^[^/\s]+/[^/\s]+$"), F.lit(False))


def upsert(base: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """new over base: rows of base whose key new has are replaced."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)
