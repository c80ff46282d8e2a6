"""Registered queries that write a test table in a format, read it back through the readers, and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import calls, joins, judgments, raters, sampling
from tallyframe.plans import adapters as A
from tallyframe.plans import provenance
from tallyframe.plans.reports import REGISTRY
from tallyframe.registry import table
from tallyframe.sources import readers, writers
from tallyframe.storage import durable, fresh_path
from tallyframe.streaming import judgments as streams

query = REGISTRY.add


@query("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, lang, source, coalesce(text, '') AS text FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    writers.delimited(docs, path, bom=True)
    rows = readers.delimited(spark, path, ["doc_id", "lang", "source", "text"])
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


@query(
    "tsv_cells",
    f"WITH {A.SQL_CELLS} SELECT cell, source, count(*)::BIGINT AS n FROM c WHERE cell IN ('I', 'III') GROUP BY cell, source",
)
def tsv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    writers.delimited(A.cells(spark, sf_dir).select("doc_id", "source", "cell"), path, sep="\t")
    rows = readers.cells(readers.delimited(spark, path, ["source", "cell"], sep="\t"), "cell", ["I", "III"])
    return rows.groupBy("cell", "source").agg(F.count("*").alias("n"))


@query("csv_missing_file", "SELECT o_orderstatus AS status, count(*)::BIGINT AS rows, 0::BIGINT AS missing_rows, true AS raw_first FROM orders GROUP BY 1")
def csv_missing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw file is read although an anonymised one is there, too; a file that is absent has no rows."""
    path = fresh_path(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    writers.delimited(rows, f"{path}/base.csv")
    writers.delimited(rows.where("status = 'none'"), f"{path}/base_anon.csv")
    found = readers.resolve(spark, f"{path}/base")
    read = lambda name, at: readers.delimited(spark, at, ["key", "status"]).select("status", F.lit(name).alias("part"))
    both = read("base", found).union(read("none", f"{path}/none.csv"))
    counts = both.groupBy("status").agg(F.count_if(F.col("part") == "base").alias("rows"), F.count_if(F.col("part") == "none").alias("missing_rows"))
    return counts.withColumn("raw_first", F.lit(found == f"{path}/base.csv"))


@query(
    "torn_json_lines",
    "SELECT event_type, count(*)::BIGINT AS good, round(sum(value), 4) AS total, 3::BIGINT AS torn FROM events GROUP BY event_type",
)
def torn_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    writers.append_json(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    spark.createDataFrame([('{"event_id": 1, "event_ty',), ("", ), ("{]",), ('{"value": "x', )], "value string").coalesce(1).write.mode("append").text(path)
    good, torn = readers.json_lines(spark, path, "event_id long, event_type string, value double")
    sums = good.groupBy("event_type").agg(F.count("*").alias("good"), F.round(F.sum("value"), 4).alias("total"))
    return sums.crossJoin(F.broadcast(torn.agg(F.count("*").alias("torn"))))


@query(
    "last_probabilities",
    "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS noul FROM labels",
)
def last_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    key = F.array(F.lit("book"), F.col("doc_id").cast("string"), F.lit("1"), F.lit("O"))
    rows = table(spark, sf_dir, "labels").select("doc_id", key.alias("key"), F.lit("O").alias("marker_type"))
    rows.select("key", "marker_type", F.lit(0.25).alias("noul")).write.json(f"{path}/1")
    rows.where("doc_id % 3 = 0").select("key", "marker_type", F.lit(0.75).alias("noul")).write.json(f"{path}/2")
    rows.select("key", "marker_type", F.lit(None).cast("double").alias("noul")).write.option("ignoreNullFields", "false").json(f"{path}/3")
    return readers.probabilities(spark, f"{path}/*").select(F.element_at("key", 2).alias("doc_id"), "noul")


@query("xml_sentences", "SELECT c_custkey::VARCHAR AS id, c_name AS text FROM customer")
def xml_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("_VALUE"))
    rows.write.format("xml").option("rootTag", "text").option("rowTag", "s").save(path)
    return readers.xml_sentences(spark, f"{path}/part-*").where("error is null").select("id", "text")


@query(
    "xml_records_in_pieces",
    "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority || ' & <' || o_orderstatus || '>' AS note, NULL::VARCHAR AS absent FROM orders",
)
def xml_records_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    note = F.concat("o_orderpriority", F.lit(" & <"), "o_orderstatus", F.lit(">"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), note.alias("note"))
    rows.write.format("xml").option("rootTag", "shelf").option("rowTag", "record").save(path)
    found = readers.xml_records(spark, f"{path}/part-*", "record", ["key", "status", "note", "absent"], whole=0)
    return found.where("error is null").drop("file", "error")


@query("xml_records", "SELECT n_name AS name, n_nationkey::VARCHAR AS key, NULL::VARCHAR AS absent FROM nation")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    rows.repartition(25, "key").write.format("xml").option("rootTag", "shelf").option("rowTag", "record").option("maxRecordsPerFile", 1).save(path)
    return readers.xml_record(spark, f"{path}/part-*", "record", ["name", "key", "absent"]).where("error is null and key is not null").drop("file", "error")


@query("markdown_answers", "SELECT trim(r_name) || chr(10) || 'key ' || r_regionkey::VARCHAR AS answer FROM region")
def markdown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    body = F.concat(F.lit("# Report\n\n## Answer\n\n"), F.trim("r_name"), F.lit("\nkey "), F.col("r_regionkey").cast("string"), F.lit("\n\n---\nmodel x\n"))
    rows = table(spark, sf_dir, "region").select(body.alias("value"))
    rows.repartition(5, "value").write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)
    return readers.markdown_answers(spark, f"{path}/part-*").select("answer")


@query("append_resumes", "SELECT o_orderstatus, count(*)::BIGINT AS n, count(DISTINCT o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")
def append_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    writers.append_new(rows.where("o_orderkey % 2 = 0"), path, ["o_orderkey"])
    writers.append_new(rows, path, ["o_orderkey"])
    found = spark.read.parquet(path)
    found = found.repartition(judgments.parts(found), "o_orderstatus", "o_orderkey")
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query(
    "file_pairs",
    "SELECT lower(replace(r_name, ' ', '_')) AS book, true AS first_named, true AS second_named FROM region WHERE r_regionkey <> 0",
)
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region has one file only, so it is no pair."""
    path = fresh_path(spark)
    regions = table(spark, sf_dir, "region").select(F.regexp_replace(F.lower("r_name"), " ", "_").alias("book"), "r_regionkey")
    for side in ("_first", "_second"):
        part = regions.where(F.lit(side == "_first") | (F.col("r_regionkey") != 0))
        part.select(F.concat("book", F.lit(f"{side}.txt")).alias("name"), F.lit("x").alias("value")).write.partitionBy("name").mode("append").text(f"{path}/raw")
    # Spark names files itself; a copy gives them the names of their folders.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/raw").select("path")
    for row in listed.collect():
        place = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/named/{row.path.split('name=')[1].split('/')[0]}")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(to.getParent())
        store.rename(place, to)
    pairs = readers.file_pairs(spark, f"{path}/named", "_first", "_second")
    return pairs.select("book", F.endswith("first", F.lit("_first.txt")).alias("first_named"), F.endswith("second", F.lit("_second.txt")).alias("second_named"))


_FROZEN = "SELECT o_orderstatus || '-' || left(o_orderpriority, 1) AS g, string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey) || chr(10) AS body, count(*)::BIGINT AS n FROM orders GROUP BY 1"


@query("frozen_copy", f"SELECT g, sha256(body) AS sha256, length(body)::BIGINT AS bytes, n - 1 AS rows, 'ok' AS state FROM ({_FROZEN})")
def frozen_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of order numbers for each status and priority is copied; manifest and copies are checked once more."""
    path = fresh_path(spark)
    g = F.concat("o_orderstatus", F.lit("-"), F.left("o_orderpriority", F.lit(1)))
    rows = table(spark, sf_dir, "orders").select(g.alias("g"), F.col("o_orderkey"))
    rows = rows.repartition("g").sortWithinPartitions("g", "o_orderkey").select("g", F.col("o_orderkey").cast("string").alias("value"))
    rows.write.partitionBy("g").text(f"{path}/run")
    frozen = provenance.freeze(spark, f"{path}/run", f"{path}/frozen", "part-*")
    both = frozen.join(provenance.verify_frozen(spark, f"{path}/frozen").select("file", "state"), "file")
    return both.select(F.regexp_extract("file", "g=([^/]+)", 1).alias("g"), "sha256", "bytes", "rows", "state")


@query("manifest_digests", f"SELECT sha256(body) AS sha256, length(body)::BIGINT AS bytes FROM ({_FROZEN})")
def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    g = F.concat("o_orderstatus", F.lit("-"), F.left("o_orderpriority", F.lit(1)))
    rows = table(spark, sf_dir, "orders").select(g.alias("g"), F.col("o_orderkey"))
    rows = rows.repartition("g").sortWithinPartitions("g", "o_orderkey").select("g", F.col("o_orderkey").cast("string").alias("value"))
    rows.write.partitionBy("g").text(path)
    return provenance.manifest(spark, path, "part-*", whole=100).select("sha256", "bytes")


@query(
    "stream_first_judgments",
    "SELECT event_type, count(*)::BIGINT AS users FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type",
)
def stream_first_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    table(spark, sf_dir, "events").select("user_id", "event_type").repartition(4, "user_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("user_id long, event_type string").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    streams.append_stream(stream, f"{path}/out", ["user_id", "event_type"], f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("users"))


_PLACES = f"WITH {A.SQL_WIDE}, b AS (SELECT *, (row_number() OVER (PARTITION BY arm ORDER BY okey, lnum) - 1) // 20 AS batch, (row_number() OVER (PARTITION BY arm ORDER BY okey, lnum) - 1) % 20 + 1 AS i FROM j)"


def _plan(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    return raters.plan(A.wide(spark, sf_dir).withColumn("body", body), "body", ["okey", "lnum"], 20)


@query("rater_votes", f"{_PLACES} SELECT arm, count(*)::BIGINT AS items, count(*) FILTER (i % 2 = 1)::BIGINT AS positive FROM b GROUP BY arm")
def rater_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline rater answers O to odd places; every item is asked about."""
    plan = durable(_plan(spark, sf_dir, F.concat_ws(" ", "flag", "arm")))
    asked = raters.ask(plan, raters.mock_rater, 100_000_000)
    votes = raters.judgments(asked, ["okey", "lnum", "arm"], 20)
    return votes.groupBy("arm").agg(F.count("*").alias("items"), F.count_if("judgment").alias("positive"))


@query(
    "rater_log",
    f"""{_PLACES}, p AS (SELECT arm, batch, max(okey) AS most, count(*) AS items FROM b GROUP BY arm, batch)
SELECT arm, count(*)::BIGINT AS prompts, count(*)::BIGINT AS answered, count(*)::BIGINT AS calls, count(*) FILTER (most % 3 = 0)::BIGINT AS asked_first, 0::BIGINT AS asked_again FROM p GROUP BY arm""",
)
def rater_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a third of the prompts, then one over all with the same log: no prompt has two records."""
    plan = durable(_plan(spark, sf_dir, F.concat_ws(" ", "okey", "lnum", "arm")))
    log = f"{fresh_path(spark)}/answers"
    first = raters.ask(plan.where(F.array_max("items.okey") % 3 == 0), raters.mock_rater, 100_000_000, log=log)
    first = first.groupBy("arm").agg(F.sum("calls").alias("asked_first"))
    first = durable(first)
    every = raters.ask(plan, raters.mock_rater, 100_000_000, log=log)
    sums = durable(every.groupBy("arm").agg(F.count("*").alias("prompts"), F.count_if(F.col("status") == "ok").alias("answered"), F.sum("calls").alias("calls")))
    records = calls.Log(log).table(spark, "status string").groupBy("key").agg((F.count("*") - 1).alias("more"))
    again = raters.keyed(plan).join(records, F.col("key_") == F.col("key")).groupBy("arm").agg(F.sum("more").alias("asked_again"))
    return sums.join(first, "arm").join(again, "arm").select("arm", "prompts", "answered", "calls", "asked_first", "asked_again")


@query(
    "manifest_override",
    "SELECT o_orderstatus AS arm, count(*)::BIGINT AS n FROM orders WHERE (o_orderstatus = 'O' AND o_orderkey % 3 = 0) OR (o_orderstatus = 'F' AND o_orderkey % 5 = 0) GROUP BY 1",
)
def manifest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    listed = rows.where("(o_orderstatus = 'O' and o_orderkey % 3 = 0) or (o_orderstatus = 'F' and o_orderkey % 5 = 0)")
    parts = sampling.override(rows, listed, ["o_orderkey"], "o_orderstatus", {a: F.col("o_orderstatus") == a for a in ("O", "F")})
    return judgments.union_all(*(part.withColumn("arm", F.lit(a)) for a, part in parts.items())).groupBy("arm").agg(F.count("*").alias("n"))


@query("id_list_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR IN ('1/1', '1/3', '7/2', '999999999/1')")
def id_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sampling.by_ids(rows, ["1/1", "1/3", "7/2", "999999999/1"], ["l_orderkey", "l_linenumber"])


@query("scope_guard", "SELECT book, CASE WHEN starts_with(book, 'vol') THEN coalesce(try_cast(regexp_extract(book, '([0-9]+)$', 1) AS INT) > 7, false) ELSE false END AS beyond FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'vol' ELSE 'set' END || '-' || (p_partkey % 12)::VARCHAR AS book, p_partkey FROM part) GROUP BY ALL")
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "vol").otherwise("set"), F.lit("-"), (F.col("p_partkey") % 12).cast("string"))
    rows = table(spark, sf_dir, "part").select(name.alias("book")).distinct()
    return rows.select("book", joins.out_of_scope("book", "vol", 7).alias("beyond"))


@query(
    "evidence_documents",
    """WITH r AS (SELECT source, doc_id, coalesce(text, '') AS t, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY source ORDER BY doc_id, coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begins FROM documents),
d AS (SELECT source, string_agg(substr(t, 1, 20001), chr(10) ORDER BY doc_id, t) AS body FROM r WHERE coalesce(begins, 0) <= 20000 GROUP BY source)
SELECT source, CASE WHEN length(body) > 20000 THEN substr(body, 1, 20000) || chr(10) || '[cut]' ELSE body END AS document, length(body) > 20000 AS cut FROM d""",
)
def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.evidence(table(spark, sf_dir, "documents"), ["source"], "text", "doc_id", 20_000)
