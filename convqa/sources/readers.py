"""Scans of the file layouts. Every scan has a declared schema and keeps the path parts as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convqa import schemas
from convqa.functions import text as tx
from convqa.operators import provenance
from convqa.operators.transcripts import from_conversations


BROKEN = "__broken"


def _path() -> Column:
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "\\+", "%2B"))


def _has_lines(spark: SparkSession, root: str, glob: str, skip: str) -> bool:
    """Whether the JSON files below ``root`` hold one record per line, or whole documents (pretty-printed, or arrays).

    Looks at the first line of each file. A record closes its braces there; a document or an array over several
    lines does not. Folders that hold both raise an error, because reading them either way would lose rows.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    spoken = lines.where(F.col("value").rlike("\\S") & ~_path().rlike(skip)).select(F.col("_metadata.file_path").alias("path"), "value", place.alias("at"))
    first = spoken.groupBy("path").agg(F.min_by("value", "at").alias("first"))
    whole = F.col("first").rlike("^\\s*\\{") & F.try_parse_json("first").isNotNull()
    got = first.agg(F.count_if(whole).alias("lines"), F.count_if(~whole).alias("documents"), F.min(F.when(~whole, F.col("path"))).alias("example")).first()
    if got["lines"] and got["documents"]:
        raise ValueError(f"{root} holds files with one record per line and others, such as {got['example']}; read them apart, or say lines=True or lines=False")
    return not got["documents"]


def _json(spark: SparkSession, root: str, schema: str | StructType, glob: str = "*.json", lines: bool | None = False, skip: str = "^$") -> DataFrame:
    """JSON files below ``root``: a record per line, a document or array per file, or (None) whichever the files hold. Rows that cannot be read raise an error when they are reached, so none is lost without a word."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    held = StructType([*fields.fields, StructField(BROKEN, StringType())])
    lines = _has_lines(spark, root, glob, skip) if lines is None else lines
    reader = spark.read.schema(held).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    read = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(root).withColumn("path", _path()).where(~F.col("path").rlike(skip))
    # Spark reads no file for the broken text alone, so the message names a field as well
    found = F.coalesce(F.col(fields.names[0]).cast("string"), F.lit("none"))
    problem = F.raise_error(F.concat(F.lit("not a record of this kind in "), F.col("path"), F.lit(f": {fields.names[0]} is "), found, F.lit(" in "), F.substring(BROKEN, 1, 80)))
    return read.withColumn("path", F.when(F.col(BROKEN).isNull(), F.col("path")).otherwise(problem)).drop(BROKEN)


def unquoted_path() -> Column:
    return _path()


def unquoted(name: str) -> str:
    """A folder name as partitions write it, without its escapes."""
    from urllib.parse import unquote

    return unquote(name)


def _folder(c: Column, up: int) -> Column:
    return F.element_at(F.split(c, "/"), -up)


def _partition(name: str) -> Column:
    """Value of a partition folder ``name=value`` of the path, null where there is none."""
    return F.nullif(F.regexp_extract("path", f"/(?:p_)?{name}=([^/]*)/", 1), F.lit(""))


def _topic_columns(df: DataFrame, suffix: str = "\\.json$") -> DataFrame:
    """Topic and sub topic out of partition folders as our sinks write them, else out of ``<topic>/<sub topic>.json``."""
    return df.withColumn("file_topic", F.coalesce(_partition("topic"), _folder(F.col("path"), 2))).withColumn(
        "file_sub_topic", F.coalesce(_partition("sub_topic"), F.regexp_replace(_folder(F.col("path"), 1), suffix, "")))


def read_questions(spark: SparkSession, root: str, topics: Sequence[str] = (), subtopics: Sequence[str] = (), lines: bool | None = None) -> DataFrame:
    """Question files; chunk files and manifests are skipped, names come from the path.

    ``lines``: true for one record per line, as our sinks write them, so a large file is read by many tasks; false for files
    ``<topic>/<sub topic>.json`` of one document or array, indented or not; by default a pass over the files finds out.
    """
    df = _topic_columns(_json(spark, root, schemas.QUESTION, lines=lines, skip="(\\.chunks|/manifest)\\.json$"))
    if topics:
        df = df.where(F.col("file_topic").isin(list(topics)))
    if subtopics:
        df = df.where(F.col("file_sub_topic").isin(list(subtopics)))
    return df


def latest_questions(questions: DataFrame) -> DataFrame:
    """One row per question id; of several files the last path wins."""
    fields = [c for c in questions.columns if c != "id"]
    return questions.groupBy("id").agg(F.max_by(F.struct(*fields), "path").alias("q")).select("id", "q.*")


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """``*.chunks.json`` files with ``match_key``, the case-folded topic and name their questions share."""
    df = _topic_columns(_json(spark, root, schemas.CHUNK, "*.chunks.json"), "(?i)\\.chunks\\.json$")
    return df.withColumn("match_key", F.lower(F.concat_ws("/", "file_topic", "file_sub_topic")))


def read_sessions(spark: SparkSession, root: str, legacy: str | None = None, lines: bool | None = None) -> DataFrame:
    """Session files below ``root``, one session per line or one document or array per file (``lines``, as for questions);
    a single old file is used only when there is none."""
    df = _topic_columns(_json(spark, root, schemas.SESSION, lines=lines)).where(F.col("session_id").isNotNull())
    if legacy and df.isEmpty():
        return _topic_columns(spark.read.schema(schemas.SESSION).option("multiLine", True).json(legacy).withColumn("path", _path()))
    return df


def session_turns(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "subtopic", "language", "agent_id", F.explode("messages").alias("m")).select(
        "session_id", "subtopic", "language", "agent_id", "m.*")


def read_run_reports(spark: SparkSession, root: str) -> DataFrame:
    """``run-results-<stamp>.json``; the stamp is the one in the name."""
    df = _json(spark, root, schemas.RUN_REPORT, "run-results-*.json")
    return df.withColumn("file", _folder(F.col("path"), 1)).withColumn("stamp", F.regexp_extract("file", "^run-results-(.+)\\.json$", 1))


def newest(df: DataFrame, stamp: str = "stamp") -> DataFrame:
    """The row with the highest stamp."""
    return df.agg(F.max_by(F.struct(*df.columns), stamp).alias("r")).where("r is not null").select("r.*")


def report_results(reports: DataFrame) -> DataFrame:
    return reports.select(F.col("stamp").alias("run_stamp"), F.explode("results").alias("r")).select(
        "run_stamp", "r.session_id", "r.language", "r.agent_id", "r.turns", "r.passed", "r.reason", "r.replies", F.col("r.conversationId").alias("conversation_id"))


ARTIFACTS = {"summary": schemas.SUMMARY, "responses": schemas.RESPONSES}


def read_artifacts(spark: SparkSession, root: str, kind: str, file_prefix: str | None = None) -> DataFrame:
    """Per-session artifacts ``<session>/<prefix>-<stamp>.json`` with session, file and stamp columns."""
    prefix = file_prefix or kind
    df = _json(spark, root, ARTIFACTS[kind], f"{prefix}-*.json")
    return df.withColumn("session_id", _folder(F.col("path"), 2)).withColumn("file", _folder(F.col("path"), 1)).withColumn(
        "stamp", F.regexp_extract("file", f"^{prefix}-(.+)\\.json$", 1)).withColumn("conversation_id", F.col("conversationId"))


def summary_checks(summaries: DataFrame) -> DataFrame:
    return summaries.select("session_id", "file", F.posexplode("checks").alias("i", "c")).select(
        "session_id", "file", (F.col("i") + 1).cast("bigint").alias("ord"), "c.clip", "c.responded", tx.finite("c.latencyMs").cast("bigint").alias("latency_ms"),
        tx.finite("c.latencyMsToFirstAudioChunk").cast("bigint").alias("first_audio_ms"), F.col("c.answerText").alias("answer_text"),
        F.col("c.responseSignal").alias("response_signal"), tx.finite("c.clipMs").alias("clip_ms"), "c.error")


def summary_transcript(summaries: DataFrame) -> DataFrame:
    return summaries.select("session_id", "file", F.posexplode("liveTranscript").alias("i", "t")).select(
        "session_id", "file", F.col("i").cast("bigint").alias("ord"), "t.speaker", "t.text")


def summary_sources(summaries: DataFrame) -> DataFrame:
    """Either spelling of the file fields; the two lists become one."""
    none = provenance.empty()
    pick = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}"), none)
    return summaries.select("session_id", "file", F.explode("sourceFilesByTurn").alias("s")).select(
        "session_id", "file", F.col("s.turn").cast("bigint").alias("turn"), F.array_union(pick("fileIds", "file_ids"), pick("loadedFiles", "loaded_files")).alias("files"),
        F.col("s.saw_source_frame").alias("saw"))


def read_flow_steps(spark: SparkSession, root: str) -> DataFrame:
    """Flat steps as ``writers.write_flow_steps`` stores them, one per line."""
    return _json(spark, root, schemas.FLOW_STEP, lines=True).where(F.col("flow_id").isNotNull())


def read_flow_specs(spark: SparkSession, root: str, lines: bool | None = None, glob: str = "*.json") -> DataFrame:
    """Flow specifications with at least one scenario, one per line or one per file (``lines``, as for questions)."""
    return _json(spark, root, schemas.FLOW_SPEC, glob, lines).where(F.size("flows") > 0)


def spec_scenarios(specs: DataFrame) -> DataFrame:
    return specs.select(F.col("flow_id").alias("__f"), "title", F.explode("flows").alias("s")).select(
            F.col("__f").alias("flow_id"), "title", "s.id", "s.pair_id", "s.mode", "s.language", "s.question", "s.expected_answer", "s.steps", "s.chunk_ids", "s.sub_topic")


def spec_chunks(specs: DataFrame) -> DataFrame:
    return specs.select(F.explode("chunks").alias("c")).select("c.*").where(F.col("id").isNotNull())


def read_flow_replies(spark: SparkSession, folder: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """All reply files of a folder: scenarios of the readable ones, and the names of the rest.

    Three forms are accepted: an object with ``flows``, one scenario, or an array of scenarios. A file is held whole; ``sources.replies``
    reads files of any size, with steps and answers as rows of their own.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    raw = raw.select(_folder(_path(), 1).alias("file"), _path().alias("path"), "value")
    tested = raw.withColumn("ok", tx.is_json("value"))
    bad = tested.where(~F.col("ok")).select("file", "path")
    text = tx.strip("value")
    scenarios = f"array<{schemas.SCENARIO}>"
    as_object = F.from_json("value", schemas.FLOW_SPEC)
    flows = F.when(text.startswith("["), F.from_json("value", scenarios)).otherwise(
        F.coalesce(as_object["flows"], F.array(F.from_json("value", schemas.SCENARIO))))
    good = tested.where("ok").select("file", F.explode(flows).alias("s")).select("file", "s.*").where(
        F.coalesce("flow_id", "id").isNotNull())
    return good, bad


def read_conversations(spark: SparkSession, path: str, fmt: str = "json", since: str | None = None, lines: bool | None = None) -> DataFrame:
    """Dump of stored calls; JSON holds one call per line or one document or array per file (``lines``, as for questions).
    ``since`` (ISO time) is compared as text first, so a columnar dump can skip row groups."""
    if fmt == "json":
        df = _json(spark, path, schemas.CONVERSATION, lines=lines).drop("path")
    else:
        df = spark.read.format(fmt).load(path)
    if since:
        df = df.where(F.col("createdAt") >= since)
    return df


def conversation_calls(convs: DataFrame) -> DataFrame:
    return convs.select(
        F.col("id").alias("conv_id"), "status", "duration", tx.parse_iso_utc(F.coalesce("createdAt", "callStartedAt")).alias("created_at"), "recording_url",
        F.col("agentId").alias("agent_id"), tx.caller_phone("metadata.participant.ani").alias("phone_number"))


def conversation_turns(convs: DataFrame) -> DataFrame:
    """Turns of stored calls, whichever field names their producer used."""
    t = lambda *names: [F.col(f"t.{n}") for n in names]
    return convs.select(F.col("id").alias("conv_id"), F.posexplode("transcription").alias("i", "t")).select(
        "conv_id", F.col("i").cast("bigint").alias("ord"), F.lower(F.coalesce(tx.first_text(*t("speaker", "role", "type")), F.lit(""))).alias("speaker"),
        tx.strip(F.coalesce(tx.first_text(*t("text", "message", "content", "transcript")), F.lit(""))).alias("text"),
        tx.finite(*t("start", "startTime", "start_time")).alias("start_s"), tx.finite(*t("end", "endTime", "end_time")).alias("end_s"),
        F.coalesce("t.is_interrupted", F.lit(False)).alias("is_interrupted"))


def read_turn_table(spark: SparkSession, path: str) -> DataFrame:
    """Flat parquet form ``conv_id, turn, role, text``."""
    return from_conversations(spark.read.parquet(path))


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """WAV files as ``call, content``; the call id is the file name without its ending."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return df.select(F.regexp_replace(_folder(F.col("path"), 1), "(?i)\\.wav$", "").alias("call"), "content")


def read_labelled_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of ``AGENT:`` / ``CUSTOMER:`` lines to turns (``conv_id`` = file name)."""
    from convqa.operators.transcripts import parse_labelled

    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return parse_labelled(raw.select(F.regexp_replace(_folder(_path(), 1), "\\.txt$", "").alias("conv_id"), F.col("value").alias("reply")))


def artifact_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Name and modification time of the files of a folder, without reading them."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return df.select(_folder(F.col("path"), 1).alias("name"), F.unix_micros("modificationTime").alias("mtime"))
