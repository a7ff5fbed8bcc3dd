"""Atomic multi-file commits with optimistic concurrency.

A store is a folder of immutable part tables and a chain of manifests, one small JSON file per
version that names the parts in order. A commit stages its rows as a new part, writes the manifest
after the one it has read under another name, and gives it its own name only if no file has it yet:
of two writers one is told of the conflict, reads the head anew and tries once more. A manifest is
thus seen whole or not at all; a torn one, that some other tool left, is passed over.

Of a stream's batches a manifest holds the last number alone. compact() writes the rows that count as
one part, so that reads stay one scan of few folders.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom.shared import file_system

ATTEMPTS = 2
COLUMNS = ("username", "label", "path", "content")


class CommitConflict(RuntimeError):
    """Another writer committed first, twice."""


class MissingStore(LookupError):
    """There is no store at that place; what a sender is told is `status`."""

    status = 400


class SampleStore:
    def __init__(self, spark: SparkSession, root: str, create: bool = True) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        if not create and not self._versions():
            raise MissingStore(f"no store at {self.root}")

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.root}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:12]) for n in names if len(n) == 17 and n.endswith(".json") and n[:12].isdigit())

    def _manifest_of(self, version: int) -> dict | None:
        """None if it is torn."""
        fs, at = file_system(self.spark, self._manifest(version))
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) and "parts" in found else None

    def head(self) -> tuple[int, dict]:
        """(last version, manifest of the latest whole commit); version 0 has no parts."""
        versions = self._versions()
        for version in reversed(versions):
            if (found := self._manifest_of(version)) is not None:
                return versions[-1], found
        return (versions[-1] if versions else 0), {"parts": [], "batches": {}}

    def _create(self, version: int, manifest: dict) -> bool:
        """False if the version is there already."""
        jvm, path = self.spark.sparkContext._jvm, self._manifest(version)
        staged = f"{self.root}/manifests/.{version:012d}-{uuid.uuid4().hex}"
        fs, at = file_system(self.spark, staged)
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(path)
        try:
            if fs.getScheme() == "file":
                # A local rename would replace a file that is there; a link to the whole file doesn't.
                paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (to, at)]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to, none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        finally:
            fs.delete(at, False)
        return True

    def commit(self, files: DataFrame, message: str, batch: str | None = None) -> int:
        """Commits rows of COLUMNS and returns the version. batch: `stream:number`, numbers rising; one
        that is there already, or came before one that is, is skipped."""
        version, manifest = self.head()
        if _seen(manifest, batch):
            return version
        part = f"parts/part={uuid.uuid4().hex}"
        files.select(*COLUMNS).write.partitionBy("username", "label").parquet(f"{self.root}/{part}")
        return self._add(lambda parts: [*parts, part], message, batch)

    def _add(self, change, message: str, batch: str | None) -> int:
        for _ in range(ATTEMPTS):
            version, manifest = self.head()
            if _seen(manifest, batch):
                return version
            batches = dict(manifest["batches"])
            if batch is not None:
                stream, number = _batch(batch)
                batches[stream] = number
            if self._create(version + 1, {"parts": change(manifest["parts"]), "batches": batches, "message": message}):
                return version + 1
        raise CommitConflict(f"version {version + 1} was taken")

    def compact(self) -> int:
        """Writes what the store holds as one part in place of those it was read from."""
        _, manifest = self.head()
        old = manifest["parts"]
        part = f"parts/part={uuid.uuid4().hex}"
        self._rows(old).write.partitionBy("username", "label").parquet(f"{self.root}/{part}")
        return self._add(lambda parts: [part, *(p for p in parts if p not in old)], "Compact", None)

    def read(self, version: int | None = None) -> DataFrame:
        """(username, label, path, content): of rows with one path, those of the latest part."""
        manifest = self.head()[1] if version is None else self._manifest_of(version)
        if manifest is None:
            raise MissingStore(f"version {version} is torn")
        return self._rows(manifest["parts"])

    def _rows(self, parts: list[str]) -> DataFrame:
        """One scan over all parts; a row's place in the chain is that of its folder."""
        schema = "path string, content binary, part string, username string, label string"
        if not parts:
            return self.spark.createDataFrame([], schema).select(*COLUMNS)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/parts").parquet(*(f"{self.root}/{p}" for p in parts))
        places = self.spark.createDataFrame([(p.partition("=")[2], k) for k, p in enumerate(parts)], "part string, _place int")
        last = rows.join(F.broadcast(places), "part").groupBy("path").agg(F.max_by(F.struct("username", "label", "content"), "_place").alias("r"))  # a row for each part
        return last.select("r.username", "r.label", "path", "r.content")


def _batch(batch: str) -> tuple[str, int]:
    stream, _, number = batch.rpartition(":")
    return stream, int(number)


def _seen(manifest: dict, batch: str | None) -> bool:
    if batch is None:
        return False
    stream, number = _batch(batch)
    return manifest["batches"].get(stream, -1) >= number


COMPACT_EVERY = 64  # batches of a stream


def commit_stream(requests: DataFrame, store: SampleStore, checkpoint: str, message: str = "Add samples"):
    """requests: a stream of (username, label, files). Every micro-batch is one commit, once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("files is not null").select("username", "label", F.explode("files").alias("f"))
        store.commit(rows.select("username", "label", "f.path", "f.content"), message, f"{checkpoint}:{number}")
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            store.compact()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
