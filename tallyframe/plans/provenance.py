"""Provenance: file manifests, verification, golden checks."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources import readers
from tallyframe.storage import durable

#: Files of up to so many bytes are hashed as one value; longer ones are read piece by piece.
WHOLE = 1 << 28


def _located(path: str) -> tuple[FileSystem, str]:
    """Store and path inside it of a path as Spark lists it."""
    return FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _pieces(store: FileSystem, inside: str) -> Iterator[bytes]:
    with store.open_input_stream(inside) as source:
        while piece := source.read(1 << 23):
            yield piece


def _digest(store: FileSystem, inside: str) -> str:
    digest = hashlib.sha256()
    for piece in _pieces(store, inside):
        digest.update(piece)
    return digest.hexdigest()


def manifest(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """Path, SHA-256 and size of each file below a folder; contents are hashed where they are read.

    A file of more than `whole` bytes never becomes one value: a task reads it in pieces.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    small = files.where(F.col("length") <= whole).select(name.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                found.append(_digest(*_located(path)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string()), batch.column(2)], ["file", "sha256", "bytes"])

    large = files.where(F.col("length") > whole).select("path", name.alias("file"), F.col("length").alias("bytes"))
    return small.union(large.mapInArrow(pieces, "file string, sha256 string, bytes long"))


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, file (the path below the folder) and bytes of each file, empty ones too, which a scan would pass over."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store, out = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    top, found = store.makeQualified(root).toString().rstrip("/") + "/", store.listFiles(root, True)
    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        if fnmatch.fnmatch(path.rpartition("/")[2], pattern):
            out.append((path, path.removeprefix(top), status.getLen()))
    return spark.createDataFrame(out, "path string, file string, bytes long")


def freeze(spark: SparkSession, folder: str, target: str, pattern: str = "*") -> DataFrame:
    """Copy the files below a folder to a target that has none yet, and return the manifest: file, sha256, bytes, rows.

    Tasks copy files piece by piece and hash them on the way; each copy is read again and hashed, too, and
    gets its name only then, so a task that runs again leaves no half copy. The manifest (rows are
    physical lines less one for a header) is written as <target>/manifest after all copies agree; where
    one does not, nothing is, and the files are named.
    """
    if readers.exists(spark, f"{target}/*"):
        raise ValueError(f"{target} is in use")
    files = _listed(spark, folder, pattern)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(target)
        for batch in batches:
            out = []
            for path, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, lines, last, place = hashlib.sha256(), 0, b"", f"{root}/files/{file}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                half = f"{place}.{uuid.uuid4().hex}.half"
                with store.open_output_stream(half) as sink:
                    for piece in _pieces(*_located(path)):
                        digest.update(piece)
                        lines, last = lines + piece.count(b"\n"), piece[-1:]
                        sink.write(piece)
                made = _digest(store, half)
                store.move(half, place)
                out.append((file, digest.hexdigest(), made, lines + (last not in (b"", b"\n")) - 1))
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(2)], ["file", "sha256", "copy_sha256", "rows", "bytes"])

    copied = durable(files.repartition("path").mapInArrow(copy, "file string, sha256 string, copy_sha256 string, rows long, bytes long"))
    if bad := [r.file for r in copied.where("sha256 <> copy_sha256").limit(20).collect()]:
        raise ValueError("copies differ: " + ", ".join(sorted(bad)))
    copied.select("file", "sha256", "bytes", "rows").write.json(f"{target}/manifest")
    return read_manifest(spark, target)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("file string, sha256 string, bytes long, rows long").json(f"{target}/manifest")


def verify_frozen(spark: SparkSession, target: str) -> DataFrame:
    """State of each file of a frozen copy against its manifest: ok, changed or missing; every file is hashed again."""
    files = _listed(spark, f"{target}/files", "*")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(*_located(path)) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string())], ["file", "sha256"])

    return verify(files.mapInArrow(hashed, "file string, sha256 string"), read_manifest(spark, target))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """State of each expected file: ok, changed or missing."""
    known = found.select("file", F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return expected.join(known, "file", "left").select("file", "sha256", "found", state.alias("state"))


def require(states: DataFrame) -> None:
    """Raise if a file is not as expected; looks at a few offending rows only."""
    bad = states.where("state <> 'ok'").limit(20).collect()
    if bad:
        raise ValueError("files not as expected: " + ", ".join(f"{r.file} {r.state}" for r in bad))


def line_counts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Physical lines of each text file, less one for the header."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return lines.groupBy(name.alias("file")).agg((F.count("*") - 1).alias("rows"))


def golden(result: DataFrame, expected: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows whose fields differ from the expected ones, nulls being equal."""
    a, b = result.alias("a"), expected.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return a.join(b, same, "full").where(differ).select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in key))


def canonical_hash(value: Any) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
