"""Line files, record keys, totals beside null groups, frame kinds, odd recordings and the shared folder."""

import io
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convqa import session
from convqa.config import CallConfig
from convqa.operators import audio, evaluation as ev, kb, reporting
from convqa.sources import readers, writers
from convqa.streaming import frames as fr
from convqa.streaming.scoring import score_stream

RECORD = "run_stamp string, session_id string, turn int, language string, question string, answer string, expected_answer string, source_chunks array<string>"


def records(spark, stamps=("r1", "r2")):
    rows = [(s, "S1", t, lang, "what is it", a, "it is this", ["it is this"]) for s in stamps for t, lang, a in ((1, "en", "it is this"), (2, None, ""), (2, None, ""), (None, "de", "this"))]
    return spark.createDataFrame(rows, RECORD)


def test_line_files_come_back_whole(spark, tmp_path):
    q = spark.createDataFrame([(f"Q{k}", "en", "Loan", "Car Loan", f"q{k}") for k in range(40)], "id string, language string, topic string, sub_topic string, question string")
    writers.write_questions(q.coalesce(1), str(tmp_path / "q"))
    back = readers.read_questions(spark, str(tmp_path / "q"))
    assert back.count() == 40 and {(r.file_topic, r.file_sub_topic) for r in back.collect()} == {("Loan", "Car Loan")}
    assert readers.read_questions(spark, str(tmp_path / "q"), subtopics=["Car Loan"]).count() == 40
    calls = "\n".join('{"id": "c%d", "createdAt": "2026-01-0%d", "transcription": [{"speaker": "agent", "text": "hi"}]}' % (k, k) for k in range(1, 6))
    (tmp_path / "dump.json").write_text(calls)
    assert readers.conversation_turns(readers.read_conversations(spark, str(tmp_path / "dump.json"))).count() == 5


def test_every_record_is_scored_once(spark):
    out = ev.score(records(spark), ev.overlap_judge()).collect()
    assert len(out) == 8 and sum(r.error == ev.UNANSWERED for r in out) == 4
    assert sum(r.turn is None and r.metrics[0].score > 0 for r in out) == 2
    late = ev.pending(records(spark), ev.score(records(spark, ["r1"]), ev.overlap_judge()))
    assert {r.run_stamp for r in late.collect()} == {"r2"} and late.count() == 4

    def short(batches):
        for b in batches:
            yield pd.DataFrame([], columns=list(ev.RESULT_COLUMNS))

    with pytest.raises(Exception, match="0 results"):
        ev.score(records(spark), short).collect()


def test_stream_keeps_runs_and_judges_apart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for stamp in ("r1", "r2"):
        records(spark, [stamp]).write.mode("append").parquet(src)
        for judge in ("a", "b"):
            stream = spark.readStream.schema(RECORD).parquet(src)
            score_stream(stream, ev.overlap_judge(), out, str(tmp_path / judge / stamp), judge_name=judge).awaitTermination()
    got = spark.read.parquet(out).groupBy("run_stamp", "judge").count().collect()
    assert {(r.run_stamp, r.judge): r["count"] for r in got} == {(s, j): 3 for s in ("r1", "r2") for j in ("a", "b")}


def test_totals_are_not_null_groups(spark):
    df = records(spark).withColumn("latency_ms", F.lit(5))
    stats = ev.answer_stats(df, ["language"]).collect()
    assert sorted(r.scope for r in stats) == ["language"] * 3 + ["overall"]
    heads = ev.summary(ev.score(records(spark), ev.overlap_judge())).select("scope", "language", "records").distinct().collect()
    assert sorted((r.scope, r.language or "", r.records) for r in heads) == [("language", "de", 2), ("language", "en", 6), ("overall", "", 8)]
    pool = spark.createDataFrame([("T", "a", "ar"), ("T", None, "en")], "topic string, sub_topic string, language string")
    assert sorted((r.scope, r.total) for r in reporting.manifest(pool).collect()) == [("sub_topic", 1), ("sub_topic", 1), ("topic", 2)]
    chunks = spark.createDataFrame([(None, "p"), ("en", None)], "language string, type string")
    assert sorted((r.scope, r.chunks) for r in kb.chunk_counts(chunks).collect()) == [("language", 1), ("language", 1), ("type", 1), ("type", 1)]


def test_frame_kinds(spark):
    at = [("s", 1, 0, 0, "send", None), ("s", 1, 500, 1, "sources", None), ("s", 1, 1000, 2, "error", None), ("s", 1, 2000, 3, "sentence", "a"), ("s", 1, 6000, 4, "detection", None), ("s", 1, 9000, 5, "chunk", "b"), ("s", 1, 13_000, 6, "sources", None)]
    log = spark.createDataFrame(at, "session_id string, send_no bigint, at bigint, seq bigint, kind string, sentence string").withColumn("ts", F.timestamp_millis("at"))
    config = CallConfig(settle_ms=5_000, confirm_ms=500, turn_timeout_ms=20_000)
    assert [tuple(r) for r in fr.close_turns_batch(log, config).collect()] == [("s", 1, "a b", 2000, "silence")]
    frames = log.where("kind <> 'send'")
    one = fr.assemble(frames, config).collect()
    assert [(r.answer, r.frames) for r in one] == [("a b", 4)]
    sends = log.where("kind = 'send'").select("session_id", "send_no", F.col("ts").alias("sent_at"))
    assert fr.first_latency(fr.latency(sends, frames, config)).first()["latency_ms"] == 2000


def wav(samples, header_samples=None):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.zeros((samples, 2), "<i2").tobytes())
    data = bytearray(out.getvalue())
    if header_samples:
        data[40:44] = (header_samples * 4).to_bytes(4, "little")
    return bytes(data)


def test_short_and_truncated_recordings(spark):
    df = spark.createDataFrame([("short", wav(10)), ("none", wav(0)), ("cut", wav(8000, 800_000))], "call string, content binary")
    got = {r.call: r for r in audio.frames(df).groupBy("call").agg(F.count("frame").alias("frames"), F.max("duration_s").alias("s"), F.max("error").alias("error")).collect()}
    assert (got["short"].frames, got["none"].frames, got["cut"].frames) == (0, 0, 100)
    assert got["cut"].s == 1.0 and got["short"].error is None and got["cut"].error is None
    runs = audio.speech_runs(audio.frames(df))
    assert runs.count() == 0


def test_shared_folder_is_required_off_one_machine():
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Far)
