"""Sources: delimited text, JSON lines, XML, Markdown answers, file pairs, manifests."""

from __future__ import annotations

import itertools
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import strip
from tallyframe.operators.judgments import dedupe


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern has files, in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def _strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, sep: str = ",", malformed: str = "PERMISSIVE"
) -> DataFrame:
    """Text tables with a header, as strings; quoted fields may hold line ends and quotes.

    A byte-order mark before the first name is dropped. Missing files give an empty table, for which
    columns are needed. malformed="DROPMALFORMED" skips lines that do not fit.
    """
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], _strings(columns or []))
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("mode", malformed)
    rows = reader.csv(found)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.select(*columns) if columns else rows


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve(spark: SparkSession, stem: str, source: str = "auto", suffix: str = ".csv", hidden: str = "_anon") -> str:
    """Path of the raw or the anonymised variant; "auto" takes the raw one if it is there."""
    raw, anon = f"{stem}{suffix}", f"{stem}{hidden}{suffix}"
    return {"raw": raw, "anon": anon}.get(source) or (raw if exists(spark, raw) else anon)


def cells(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(values))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records and torn lines of JSON-lines files; a missing file gives none of either."""
    lines = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    read = lines.withColumn("record", F.from_json("value", T._parse_datatype_string(f"struct<{_fields(schema)}, _torn: string>"), {"columnNameOfCorruptRecord": "_torn"}))
    torn = F.col("record._torn").isNotNull()
    lines = read.where(F.trim("value") != "")
    return lines.where(~torn).select("record.*").drop("_torn"), lines.where(torn).select(F.col("value").alias("line"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields)


def probabilities(spark: SparkSession, path: str, key: str = "key", value: str = "noul") -> DataFrame:
    """Probability judgments: the last record of each key with a probability.

    Order is that of file names, of the blocks that a file is read in, and of places in a block. A
    missing file gives no rows.
    """
    schema = f"{key} array<string>, marker_type string, {value} double, model string, batch long"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = rows.select("*", at.alias("at_")).where(F.col(value).isNotNull())
    return dedupe(rows, [key], ["at_"]).drop("at_")


def json_document(spark: SparkSession, path: str) -> DataFrame | None:
    """One JSON document as rows; None if it is not there."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else None


#: XML files of up to so many bytes are parsed as a whole; longer ones element by element, in several tasks.
WHOLE = 1 << 26


def _in_piece(piece: str, tag: str) -> Iterator[str]:
    """Elements of a tag in a piece of a file that ends before an end tag, or after the last one."""
    starts = list(re.finditer(rf"<{re.escape(tag)}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", piece))
    for i, m in enumerate(starts):
        if m[0].endswith("/>"):
            yield m[0]
        elif i + 1 == len(starts) or all(x[0].endswith("/>") for x in starts[i + 1 :]):
            yield piece[m.start() :] + f"</{tag}>"
            return


#: Bytes of a file that a parser is given at once, and elements of a file that are rows of one batch.
_BYTES, _ROWS = 1 << 16, 5_000


class _Ignored:
    """Takes what a parser finds and keeps nothing."""

    def start(self, tag: str, attributes: dict) -> None: ...

    def end(self, tag: str) -> None: ...

    def data(self, text: str) -> None: ...

    def close(self) -> None: ...


def _check(body: bytes) -> None:
    """Raises the ParseError of a broken document, without a tree of it."""
    parser = ET.XMLParser(target=_Ignored())
    for at in range(0, len(body), _BYTES):
        parser.feed(body[at : at + _BYTES])
    parser.close()


def _each(body: bytes, tag: str) -> Iterator[ET.Element]:
    """Elements of a tag in a sound document, in order; the tree never holds more than the outermost of them that is being read."""
    parser, above, inside = ET.XMLPullParser(("start", "end")), [], 0
    for at in range(0, len(body) + 1, _BYTES):
        parser.feed(body[at : at + _BYTES])
        for event, element in parser.read_events():
            if event == "start":
                above.append(element)
                inside += element.tag == tag
                continue
            above.pop()
            inside -= element.tag == tag
            if not inside:
                if element.tag == tag:
                    yield from element.iter(tag)
                if above:
                    above[-1].remove(element)


def _elements(spark: SparkSession, path: str, tag: str, names: list[str], take: Callable[[ET.Element], tuple], whole: int, first: bool = False) -> DataFrame:
    """file, the names with what `take` makes of each element of a tag, and error.

    A file of up to `whole` bytes is one value, and one row with an error if it is broken. Larger files
    are cut at the tag's end, so Spark reads each of them in several tasks, and an element is parsed
    by itself: elements of the tag do not hold each other, a broken one gives a row with its error, what
    is wrong between elements is passed over, and one in which the file ends is as long as it is. With `first`, only the first element of a small file.
    """
    files = spark.read.format("binaryFile").load(path)
    schema = ", ".join(f"`{c}` string" for c in ["file", *names, "error"])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * (len(names) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", *names, "error"])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nothing = [None] * len(names)
                try:
                    _check(body)
                except ET.ParseError as error:
                    yield rows([(name, *nothing, str(error))])
                    continue
                found = ((name, *take(e), None) for e in _each(body, tag))
                if first:
                    yield rows([next(found, (name, *nothing, None))])
                    continue
                while part := list(itertools.islice(found, _ROWS)):
                    yield rows(part)

    def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for element in _in_piece(piece, tag):
                    try:
                        out.append((name, *take(ET.fromstring(element)), None))
                    except ET.ParseError as error:
                        out.append((name, *[None] * len(names), str(error)))
            yield rows(out)

    small = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(at_once, schema)
    large = [r.path for r in files.where(F.col("length") > whole).select("path").collect()]
    if not large:
        return small
    pieces = spark.read.option("lineSep", f"</{tag}>").text(large).select(F.col("_metadata.file_path").alias("path"), "value")
    # A last piece without a start of the tag has no element.
    return small.union(pieces.where(F.contains("value", F.lit(f"<{tag}"))).mapInArrow(in_pieces, schema))


def xml_sentences(spark: SparkSession, path: str, tag: str = "s", key: str = "id", whole: int = WHOLE) -> DataFrame:
    """file, id, text and error of each sentence element, with the text of elements inside it.

    A broken file gives one row with its error and neither id nor text; see _elements() for files of
    more than `whole` bytes.
    """
    return _elements(spark, path, tag, ["id", "text"], lambda e: (e.get(key), "".join(e.itertext()).strip()), whole)


def _children(names: list[str]) -> Callable[[ET.Element], tuple]:
    return lambda record: tuple(("".join(e.itertext()).strip() or None) if (e := record.find(f)) is not None else None for f in names)


def xml_record(spark: SparkSession, path: str, root: str, fields: list[str]) -> DataFrame:
    """Named child elements of the first record, one row per file; null where one is absent. A broken file has an error."""
    return _elements(spark, path, root, fields, _children(fields), 1 << 62, first=True)


def xml_records(spark: SparkSession, path: str, root: str, fields: list[str], whole: int = WHOLE) -> DataFrame:
    """The same for all records of each file, one row per record, in several tasks where a file has more than `whole` bytes."""
    return _elements(spark, path, root, fields, _children(fields), whole)


def file_pairs(spark: SparkSession, folder: str, first: str, second: str) -> DataFrame:
    """Names with both a first and a second file, from file names that hold either part."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    side = F.when(F.contains(name, F.lit(first)), "first").when(F.contains(name, F.lit(second)), "second")
    book = F.substring_index(F.substring_index(name, first, 1), second, 1)
    rows = files.select("path", side.alias("side"), book.alias("book")).where("side is not null")
    pairs = rows.groupBy("book").agg(
        F.min(F.when(F.col("side") == "first", F.col("path"))).alias("first"), F.min(F.when(F.col("side") == "second", F.col("path"))).alias("second")
    )
    return pairs.where("first is not null and second is not null")


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """The first path of a file below a folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
        return files.agg(F.min("path")).first()[0]
    except AnalysisException:
        return None


def unfinished(spark: SparkSession, wanted: DataFrame, folder: str, name: str = "file", least: int = 200) -> DataFrame:
    """Rows of which the named output is not in the folder, or has fewer than `least` bytes."""
    if not exists(spark, f"{folder}/*"):
        return wanted
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    whole = files.where(F.col("length") >= least).select(F.element_at(F.split("path", "/"), -1).alias(name)).distinct()
    return wanted.join(whole, name, "left_anti")


def markdown_answers(spark: SparkSession, path: str, heading: str = "## Answer", end: str = "\n---") -> DataFrame:
    """file and the text between a heading and a separator."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    after = F.element_at(F.split("value", heading, 2), -1)
    return files.where(F.contains("value", F.lit(heading))).select("file", strip(F.substring_index(after, end, 1)).alias("answer"))
