"""Immutable releases of ordered JSON Lines with a manifest; verified reading; an atomic pointer; promotion with rollback."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import multiset
from . import strict_json

#: Schemas of a manifest and of a pointer; names of streams; rows of a file at most.
MANIFEST, POINTER = "release-v1", "active-release-v1"
STREAM = re.compile(r"[A-Za-z0-9._-]{1,64}")
FILE_ROWS = 200_000
_FILE = "path string, sha256 string, bytes long"


def encoded(value) -> bytes:
    """JSON with sorted keys and no spaces: equal values give equal bytes."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


class Files:
    """The file system of a path, by Spark's own configuration: any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def name(self, path: str) -> str:
        """The path with its scheme, dots and double slashes resolved."""
        return self.fs.makeQualified(self.at(path)).toString()

    def parent(self, path: str) -> str:
        return self.at(path).getParent().toString()

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()

    def move(self, source: str, target: str) -> None:
        """Rename to a name that is not taken, its parent made if absent."""
        if not self.exists(source):
            raise FileNotFoundError(f"{source} is not there")
        if self.exists(target):
            raise FileExistsError(f"{target} is there already")
        self.fs.mkdirs(self.at(self.parent(target)))
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    def replace(self, source: str, target: str) -> None:
        """Rename over whatever has the name, in one step."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.at(source), self.at(target), over)

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def _file_table(spark: SparkSession, folder: str) -> DataFrame:
    """Path below ``folder``, SHA-256 and size of each file of a release's streams; files are of FILE_ROWS rows at most."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/streams")
    below = F.element_at(F.split("path", "/streams/"), -1)
    return found.select(below.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _digest(table: DataFrame) -> dict:
    row = table.agg(*multiset(F.sha2(F.concat_ws("\x1f", "path", "sha256", "bytes"), 256))).first()
    return {"count": row["n"], "digest": row["digest"]}


def _stream_digests(spark: SparkSession, folder: str, names: list[str]) -> dict:
    out = {name: {"count": 0, "digest": ""} for name in names}
    there = [name for name in names if Files(spark, folder).exists(f"{folder}/streams/{name}")]
    if there:
        lines = spark.read.text([f"{folder}/streams/{name}" for name in there]).select("value", F.element_at(F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/streams/"), -1), "/"), 1).alias("stream"))
        out |= {r["stream"]: {"count": r["n"], "digest": r["digest"]} for r in lines.groupBy("stream").agg(*multiset(F.sha2("value", 256))).collect()}
    return out


def export_release(streams: dict[str, tuple[DataFrame, list[str]]], path: str, corpus: str, version: str, tasks: int | None = None, rows: int = FILE_ROWS) -> dict:
    """Write each stream (rows, order) as ordered JSON Lines with a manifest, and give the manifest back.

    Rows are dealt out in ranges of their order: file names sort like their
    rows, and no stream is one task. All is written beside ``path`` and renamed
    at the end, so a release is whole or absent, and never overwritten
    (FileExistsError). The manifest has counts and order-free digests of rows by
    stream, and the digest of the table of files, which is written too.
    """
    spark = next(iter(streams.values()))[0].sparkSession
    if bad := [n for n in streams if not STREAM.fullmatch(n)]:
        raise ValueError(f"names of streams have 1 to 64 letters, digits, dots, underscores and hyphens: {bad}")
    files = Files(spark, path)
    if files.exists(path):
        raise FileExistsError(f"a release is never overwritten: {path}")
    staging = f"{files.parent(path)}/.release-{uuid.uuid4().hex}"
    try:
        for name, (df, order) in streams.items():
            parts = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            dealt.write.option("maxRecordsPerFile", rows).option("ignoreNullFields", "false").json(f"{staging}/streams/{name}")
        table = _file_table(spark, staging)
        table.write.parquet(f"{staging}/files")
        body = {"schema": MANIFEST, "corpus": corpus, "version": version, "streams": _stream_digests(spark, staging, list(streams)), "files": _digest(spark.read.schema(_FILE).parquet(f"{staging}/files"))}
        manifest = body | {"release_id": hashlib.sha256(encoded(body)).hexdigest()}
        files.write(f"{staging}/manifest.json", encoded(manifest) + b"\n")
        files.move(staging, path)
    except BaseException:
        files.drop(staging)
        raise
    return manifest


def read_manifest(spark: SparkSession, path: str, corpus: str | None = None) -> dict:
    """The manifest of a release; ValueError if it is not one, was changed, or is of another corpus."""
    files = Files(spark, path)
    if not files.exists(f"{path}/manifest.json"):
        raise ValueError(f"no release at {path}")
    manifest = json.loads(files.read(f"{path}/manifest.json"), object_pairs_hook=strict_json._unique)
    body = {k: v for k, v in manifest.items() if k != "release_id"}
    if manifest.get("schema") != MANIFEST or hashlib.sha256(encoded(body)).hexdigest() != manifest.get("release_id"):
        raise ValueError("the manifest was changed or has another schema")
    if corpus is not None and manifest["corpus"] != corpus:
        raise ValueError(f"the release is of corpus {manifest['corpus']}")
    return manifest


def verify_release(spark: SparkSession, path: str, corpus: str | None = None) -> dict:
    """Check manifest, files and rows of a release, and give the manifest; ValueError names the first thing that differs."""
    manifest = read_manifest(spark, path, corpus)
    listed = spark.read.schema(_FILE).parquet(f"{path}/files")
    if _digest(listed) != manifest["files"]:
        raise ValueError("the table of files was changed")
    both = listed.select("path", F.struct("sha256", "bytes").alias("want")).join(_file_table(spark, path).select("path", F.struct("sha256", "bytes").alias("have")), "path", "full")
    fault = F.when(F.col("have").isNull(), "a file is missing").when(F.col("want").isNull(), "a file is not in the manifest").when(F.col("have") != F.col("want"), "a file was changed")
    bad = both.select("path", fault.alias("fault")).where("fault is not null").orderBy("path").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['fault']}: {bad[0]['path']}")
    found = _stream_digests(spark, path, list(manifest["streams"]))
    for name, want in manifest["streams"].items():
        if found[name]["count"] != want["count"] or (want["count"] and found[name] != want):
            raise ValueError(f"the rows of a stream differ: {name}")
    return manifest


def read_release(spark: SparkSession, path: str, schemas: dict[str, str], corpus: str | None = None) -> dict[str, DataFrame]:
    """Streams of a release by their schemas, after all of it was verified and every line parsed strictly.

    ValueError if the release has other streams than ``schemas``.
    """
    manifest = verify_release(spark, path, corpus)
    if set(manifest["streams"]) != set(schemas):
        raise ValueError(f"the release has streams {sorted(manifest['streams'])}")
    return {name: strict_json.read_strict(spark, [f"{path}/streams/{name}"], schema) for name, schema in schemas.items()}


def activate(spark: SparkSession, path: str, pointer: str) -> dict:
    """Verify a release and make ``pointer`` name it, by one rename over the old pointer; a failure leaves the old one.

    The pointer lies outside of the release and holds the manifest's digest.
    """
    files = Files(spark, pointer)
    at, name = files.name(path), files.name(pointer)
    if name == at or name.startswith(at + "/"):
        raise ValueError("the pointer lies outside of releases")
    manifest = verify_release(spark, path)
    value = {"schema": POINTER, "release": at, "release_id": manifest["release_id"], "sha256": hashlib.sha256(Files(spark, path).read(f"{path}/manifest.json")).hexdigest()}
    fresh = f"{files.parent(name)}/.active-{uuid.uuid4().hex}"
    files.write(fresh, encoded(value) + b"\n")
    try:
        files.replace(fresh, name)
    except BaseException:
        files.drop(fresh)
        raise
    return value


def active_release(spark: SparkSession, pointer: str) -> str:
    """The path of the active release; ValueError without a pointer, or if its release's manifest was changed since."""
    files = Files(spark, pointer)
    if not files.exists(pointer):
        raise ValueError(f"no active release at {pointer}")
    value = json.loads(files.read(pointer))
    path = value["release"]
    if value.get("schema") != POINTER or read_manifest(spark, path)["release_id"] != value["release_id"] or hashlib.sha256(Files(spark, path).read(f"{path}/manifest.json")).hexdigest() != value["sha256"]:
        raise ValueError("the active release was changed")
    return path


def promote(spark: SparkSession, staged: str, target: str, scopes: list[str], run: str, verify: Callable[[str], object] | None = None) -> None:
    """Move each of ``scopes`` from ``staged`` to ``target``; what was there goes to ``run``/backup.

    ``verify`` gets the target at the end. If it or a rename fails, all moved
    scopes go to ``run``/failed and the old ones back, last first, and the error
    goes on: the target is as before.
    """
    files = Files(spark, target)
    touched: list[tuple[str, bool]] = []
    try:
        for scope in scopes:
            there = files.exists(f"{target}/{scope}")
            touched.append((scope, there))
            if there:
                files.move(f"{target}/{scope}", f"{run}/backup/{scope}")
            files.move(f"{staged}/{scope}", f"{target}/{scope}")
        if verify:
            verify(target)
    except BaseException:
        for scope, there in reversed(touched):
            saved = files.exists(f"{run}/backup/{scope}")
            if there and not saved:
                continue  # the old one was not moved away
            if files.exists(f"{target}/{scope}"):
                files.move(f"{target}/{scope}", f"{run}/failed/{scope}")
            if saved:
                files.move(f"{run}/backup/{scope}", f"{target}/{scope}")
        raise
