"""Queries over the reference's own file forms: pretty-printed arrays, one document a file, many sessions' folders."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.plans import inputs as i
from convqa.plans.registry import query, table
from convqa.session import materialize, scratch_path
from convqa.sources import arrays, readers
from convqa.streaming import frames as fr


def _placed_by_tasks(dealt: DataFrame, root: str, ending: str) -> DataFrame:
    """Names of the files that tasks wrote below a folder on a shared disk, each from its neighbouring rows ``file, value``."""
    below = re.sub("^file:/+", "/", root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, begun = None, None, f".begun-{uuid.uuid4().hex}"

        def end() -> None:
            if out is not None:
                out.close()
                os.replace(f"{below}/{name}{ending}{begun}", f"{below}/{name}{ending}")

        for batch in batches:
            made = []
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    end()
                    name = file
                    made.append(name)
                    os.makedirs(os.path.dirname(f"{below}/{name}"), exist_ok=True)
                    out = open(f"{below}/{name}{ending}{begun}", "w", encoding="utf-8", newline="")
                out.write((value or "") + "\n")
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["file"])
        end()

    return dealt.mapInArrow(run, "file string")


def _placed_by_moving(dealt: DataFrame, root: str, ending: str) -> DataFrame:
    """The same in any store that Spark writes to: a folder per file, whose only piece is moved to its place."""
    spark = dealt.sparkSession
    out = scratch_path(spark, "parts")
    dealt.select("value", "file").write.partitionBy("file").text(out)
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(out)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for place in store.globStatus(path(f"{out}/file=*/part-*")):
        names.append((readers.unquoted(place.getPath().getParent().getName()[len("file="):]),))
        target = path(f"{root}/{names[-1][0]}{ending}")
        store.mkdirs(target.getParent())
        if not store.exists(target) and not store.rename(place.getPath(), target):
            raise OSError(f"{target} cannot be placed")
    return spark.createDataFrame(names, "file string")


def named_files(lines: DataFrame, root: str, ending: str) -> str:
    """Text files ``<file><ending>`` below the new folder ``root`` (``file`` may name folders) from rows ``file, at, value``, in the order of ``at``.

    Tasks write the files themselves where the folder is on a shared disk: Spark's writer takes some 50 ms of work for a small file there.
    """
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        raise OSError(f"{root} is there already; its files would be in several pieces")
    store.mkdirs(path)
    named = lines.select(F.coalesce("file", F.lit("_")).alias("file"), "at", "value")
    # dealt by a hash of the name: the planner takes rows that a join has dealt by the name as they are, and may then read that join task by task
    dealt = named.repartition(F.xxhash64("file")).sortWithinPartitions("file", "at").select("file", "value")
    placed = _placed_by_tasks if store.getScheme() == "file" else _placed_by_moving
    twice = materialize(placed(dealt, root, ending), "placed").groupBy("file").count().where("count > 1").first()
    if twice:
        raise OSError(f"{twice['file']}{ending} is in several pieces")
    return root


def as_array(records: DataFrame, file: str, order: str, indent: bool = True) -> DataFrame:
    """Lines of one JSON array per file, a record (column ``value``) over several lines where ``indent`` says so."""
    first = records.groupBy(F.col(file).alias("file")).agg(F.min(order).alias("__first"))
    body = F.replace("value", F.lit('","'), F.lit('",\n    "')) if indent else F.col("value")
    rows = records.withColumnRenamed(file, "file").join(first, "file").select(
        "file", F.struct(F.lit(1).alias("k"), F.col(order).cast("bigint").alias("n")).alias("at"), F.concat(F.when(F.col(order) == F.col("__first"), "").otherwise(","), body).alias("value"))
    edge = lambda k, mark: first.select("file", F.struct(F.lit(k).alias("k"), F.lit(0).cast("bigint").alias("n")).alias("at"), F.lit(mark).alias("value"))
    return edge(0, "[").unionByName(rows).unionByName(edge(2, "]"))


@query("a2_chunk_files", "SELECT 'kb' AS file_topic, coalesce(source, 'none') AS file_sub_topic, 'kb/' || coalesce(source, 'none') AS match_key, format('chunk_{:03d}', doc_id) AS id, md5(text) AS text FROM documents")
def _(spark, d):
    """Chunk arrays by source, indented, as ``<topic>/<name>.chunks.json``."""
    doc = table(spark, d, "documents")
    record = F.to_json(F.struct(tx.padded_id("chunk_", "doc_id").alias("id"), "text"))
    lines = as_array(doc.select(F.concat(F.lit("kb/"), F.coalesce("source", F.lit("none"))).alias("f"), "doc_id", record.alias("value")), "f", "doc_id")
    root = named_files(lines, scratch_path(spark, "chunks"), ".chunks.json")
    return readers.read_chunks(spark, root).select("file_topic", "file_sub_topic", "match_key", "id", F.md5("text").alias("text"))


@query("a2_chunk_arrays", "SELECT 'kb/' || coalesce(source, 'none') || '.chunks.json' AS file, format('chunk_{:03d}', doc_id) AS id, md5(text) AS text FROM documents")
def _(spark, d):
    """The same files by the scan that cuts an array over many tasks."""
    doc = table(spark, d, "documents")
    record = F.to_json(F.struct(tx.padded_id("chunk_", "doc_id").alias("id"), "text"))
    lines = as_array(doc.select(F.concat(F.lit("kb/"), F.coalesce("source", F.lit("none"))).alias("f"), "doc_id", record.alias("value")), "f", "doc_id")
    root = named_files(lines, scratch_path(spark, "chunks"), ".chunks.json")
    got = arrays.read_json_array(spark, root, "id string, text string", "*.chunks.json")
    return got.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), "id", F.md5("text").alias("text"))


REPORTS = "o_orderpriority || '-' || strftime(o_orderdate, '%Y')"


@query("a4_run_reports", f"""SELECT regexp_replace({REPORTS}, ' ', '_', 'g') AS stamp, o_orderkey AS session_id, CASE WHEN o_custkey % 2 = 0 THEN 'ar' ELSE 'en' END AS language, o_orderstatus = 'F' AS passed, o_orderkey % 5 + 1 AS turns FROM orders""")
def _(spark, d):
    """Reports of runs with their results nested, one document per run."""
    o = table(spark, d, "orders").withColumn("stamp", F.regexp_replace(F.concat("o_orderpriority", F.lit("-"), F.date_format("o_orderdate", "yyyy")), " ", "_"))
    result = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("session_id"), F.when(F.col("o_custkey") % 2 == 0, "ar").otherwise("en").alias("language"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("turns"), (F.col("o_orderstatus") == "F").alias("passed")))
    results = as_array(o.select("stamp", "o_orderkey", result.alias("value")), "stamp", "o_orderkey", indent=False)
    # the array of results stands inside the run's object
    framed = results.withColumn("value", F.when(F.col("at.k") == 0, F.concat(F.lit('{"stamp":"'), "file", F.lit('","results":['))).when(F.col("at.k") == 2, "]}").otherwise(F.col("value")))
    root = named_files(framed.withColumn("file", F.concat(F.lit("run-results-"), "file")), scratch_path(spark, "reports"), ".json")
    r = readers.report_results(readers.read_run_reports(spark, root))
    return r.select(F.col("run_stamp").alias("stamp"), F.col("session_id").cast("bigint").alias("session_id"), "language", "passed", F.col("turns").cast("bigint").alias("turns"))


@query("a6_session_artifacts", """SELECT 'S' || s_suppkey AS session_id, '2026-01-0' || (s_suppkey % 9 + 1) AS stamp, CAST(k AS BIGINT) AS ord, 'clip' || k AS clip, (s_suppkey + k) % 3 <> 0 AS responded,
  CASE WHEN (s_suppkey + k) % 3 <> 0 THEN s_suppkey * k END AS latency_ms, md5(s_comment_like) AS answer FROM (SELECT *, unnest([1, 2]) AS k, s_name || chr(10) || '"' || s_suppkey || '" {x}' AS s_comment_like FROM supplier)""")
def _(spark, d):
    """A folder per session with its summary in it."""
    s = table(spark, d, "supplier")
    said = F.concat("s_name", F.lit('\n"'), F.col("s_suppkey").cast("string"), F.lit('" {x}'))
    check = lambda k: F.struct(
        F.lit(f"clip{k}").alias("clip"), ((F.col("s_suppkey") + k) % 3 != 0).alias("responded"), F.when((F.col("s_suppkey") + k) % 3 != 0, F.col("s_suppkey") * k).cast("double").alias("latencyMs"), said.alias("answerText"))
    value = F.to_json(F.struct(F.lit(True).alias("passed"), F.array(check(1), check(2)).alias("checks")))
    name = F.concat(F.lit("S"), "s_suppkey", F.lit("/summary-2026-01-0"), F.col("s_suppkey") % 9 + 1)
    root = named_files(s.select(name.alias("file"), F.lit(0).alias("at"), value.alias("value")), scratch_path(spark, "runs"), ".json")
    summaries = readers.read_artifacts(spark, root, "summary")
    checks = readers.summary_checks(summaries).join(summaries.select("session_id", "stamp"), "session_id")
    return checks.select("session_id", "stamp", "ord", "clip", "responded", "latency_ms", F.md5("answer_text").alias("answer"))


DUMP = """SELECT 'C' || conv_id AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, lower(role) AS speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations"""


def _dump(spark, d, files: int) -> str:
    """Stored calls with their turns nested, as indented arrays in a few files."""
    c = table(spark, d, "conversations")
    # a call's turns are its record
    calls = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("message"))).alias("transcription"))
    value = F.to_json(F.struct(F.concat(F.lit("C"), "conv_id").alias("id"), F.lit("2026-01-01T00:00:00Z").alias("createdAt"), "transcription"))
    lines = as_array(calls.select(F.concat(F.lit("dump-"), F.col("conv_id") % files).alias("f"), "conv_id", value.alias("value")), "f", "conv_id")
    return named_files(lines, scratch_path(spark, "dump"), ".json")


@query("a9_json_dump", DUMP)
def _(spark, d):
    """A dump of arrays, a file read as a document; the scan finds out that it has no lines of records."""
    return readers.conversation_turns(readers.read_conversations(spark, _dump(spark, d, 7))).select("conv_id", "ord", "speaker", "text")


@query("a9_json_dump_split", DUMP)
def _(spark, d):
    """One array in one file, read by as many tasks as it has blocks."""
    spoken = arrays.read_json_array(spark, _dump(spark, d, 1), readers.schemas.CONVERSATION, "*.json")
    return readers.conversation_turns(spoken).select("conv_id", "ord", "speaker", "text")


@query("a12_labelled_transcripts", f"""WITH {i.TURNS} SELECT 'c' || conv_id AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS ord, upper(speaker) AS speaker, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM turns WHERE speaker IN ('agent', 'customer') AND text <> ''""")
def _(spark, d):
    """A text file of labelled lines per conversation."""
    t = i.turns(spark, d).where(F.col("speaker").isin("agent", "customer") & (F.col("text") != ""))
    line = F.concat(F.upper("speaker"), F.lit(": "), F.regexp_replace("text", "\\s+", " "))
    root = named_files(t.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.col("ord").alias("at"), line.alias("value")), scratch_path(spark, "labelled"), ".txt")
    return readers.read_labelled_transcripts(spark, root).select("conv_id", F.col("ord").cast("bigint").alias("ord"), "speaker", "text")


@query("a13_frame_files", "SELECT user_id AS session_id, event_id AS seq, event_type AS kind, epoch_us(ts) // 1000 AS at FROM events")
def _(spark, d):
    """The frame log as JSON files, read as a stream."""
    src, out, state = (scratch_path(spark, f"frames-{n}") for n in ("in", "out", "state"))
    log = i.frames(spark, d).select("session_id", "seq", "kind", "at")
    log.repartition(4).write.json(src)
    stream = fr.read_frames(spark, src, "session_id bigint, seq bigint, kind string, at bigint", 2)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("session_id", "seq", "kind", "at")
