import json

from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.operators import capture, kb, quality, questions, reporting, sessions
from convqa.sources import readers, writers
from convqa.streaming import frames as fr


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


Q = {"id": "Q001", "pair_id": "P001", "language": "ar", "topic": "Loan", "sub_topic": "Car Loan", "question": "q", "expected_answer": "a", "source_chunks": ["x"], "chunk_ids": ["c1"]}


def test_question_and_chunk_files(spark, tmp_path):
    put(tmp_path / "Loan" / "Car Loan.json", [Q, {**Q, "id": "Q002", "language": "en"}])
    put(tmp_path / "Loan" / "Car loan.chunks.json", [{"id": "c1", "text": "chunk"}])
    put(tmp_path / "Cards" / "Fees.json", [{**Q, "id": "Q001", "question": "later"}])
    q = readers.read_questions(spark, str(tmp_path), lines=False)
    assert {(r["file_topic"], r["file_sub_topic"], r["id"]) for r in q.collect()} == {("Loan", "Car Loan", "Q001"), ("Loan", "Car Loan", "Q002"), ("Cards", "Fees", "Q001")}
    assert readers.read_questions(spark, str(tmp_path), topics=["Cards"], lines=False).count() == 1 and readers.read_questions(spark, str(tmp_path), subtopics=["Car Loan"]).count() == 2
    assert {r["id"]: r["question"] for r in readers.latest_questions(q).collect()} == {"Q001": "q", "Q002": "q"}
    chunks = readers.read_chunks(spark, str(tmp_path))
    key = F.lower(F.concat_ws("/", "file_topic", "file_sub_topic"))
    assert q.withColumn("match_key", key).join(chunks.select("match_key", "text"), "match_key").count() == 2


def test_session_files_and_legacy(spark, tmp_path):
    s = {"session_id": "A-ar-001", "subtopic": "Loan/A", "language": "ar", "turns": 1, "messages": [{"turn": 1, "question_id": "Q001", "question": "q", "expected_answer": "a", "audio_file": "w"}]}
    put(tmp_path / "new" / "Loan" / "A.json", [s])
    put(tmp_path / "old" / "sessions.json", [{**s, "session_id": "old"}])
    (tmp_path / "empty").mkdir()
    assert readers.session_turns(readers.read_sessions(spark, str(tmp_path / "new"), str(tmp_path / "old" / "sessions.json"), lines=False)).first()["question_id"] == "Q001"
    assert readers.read_sessions(spark, str(tmp_path / "empty"), str(tmp_path / "old" / "sessions.json"), lines=False).first()["session_id"] == "old"


def test_capture_from_run_files(spark, tmp_path):
    """A text run and a call with a response extract, from files to captured answers."""
    root = tmp_path / "runs"
    put(root / "run-results-2026-01-01T00-00-00-000Z.json", {"stamp": "x", "results": []})
    put(root / "run-results-2026-02-01T00-00-00-000Z.json", {"stamp": "y", "sessions": 2, "results": [
        {"session_id": "S1", "language": "en", "agent_id": "a", "turns": 2, "passed": True, "conversationId": "c1"}, {"session_id": "S2#2", "language": "en", "conversationId": "c2"}, {"session_id": "S9", "conversationId": "c9"}]})
    base = {"agentId": "a", "env": {"appUrl": "https://app.test"}}
    put(root / "S1" / "summary-2026-02-01T00-00-05-000Z.json", {**base, "conversationId": "c1", "checks": [
        {"clip": "Q002", "responded": True, "latencyMs": 900, "answerText": "second"}, {"clip": "Q001", "responded": False, "latencyMs": None, "answerText": ""}],
        "liveTranscript": [{"speaker": "customer", "text": "two"}, {"speaker": "agent", "text": "second"}, {"speaker": "customer", "text": "one"}, {"speaker": "agent", "text": ""}],
        "sourceFilesByTurn": [{"turn": 1, "file_ids": ["f1"], "loaded_files": ["f2"], "saw_source_frame": True}, {"turn": 2, "file_ids": [], "saw_source_frame": False}]})
    put(root / "S1" / "summary-2026-03-01T00-00-05-000Z.json", {**base, "conversationId": "other", "checks": []})
    put(root / "S2#2" / "summary-2026-02-01T00-00-06-000Z.json", {**base, "conversationId": "c2", "checks": [{"clip": "001_Q001.wav", "responded": True, "latencyMs": 5}], "liveTranscript": []})
    put(root / "S2#2" / "responses-2026-02-01T00-00-06-000Z.json", {"conversationId": "c2", "exchanges": [{"ours": None, "reply": "hi"}, {"ours": "one", "reply": "told"}], "replies": [{"clip": "x", "responded": True, "latencyMs": 70}]})
    from convqa.operators import matching

    reports = readers.newest(readers.read_run_reports(spark, str(root)))
    results = readers.report_results(reports)
    assert results.count() == 3
    summaries = readers.read_artifacts(spark, str(root), "summary")
    picked = matching.match_artifacts(results.select("session_id", "run_stamp", "conversation_id"), summaries.select("session_id", "file", "stamp", "conversation_id"), True)
    mine = summaries.join(picked.select("session_id", "file"), ["session_id", "file"])
    assert {r["session_id"]: r["match"] for r in picked.collect()} == {"S1": "conversation", "S2#2": "conversation", "S9": "none"}
    built = spark.createDataFrame([("S1", 1, "en", "Q001", "one", "e1", None), ("S1", 2, "en", "Q002", "two", "e2", None), ("S2", 1, "en", "Q001", "one", "e1", "own")],
                                  "session_id string, turn int, language string, question_id string, question string, expected_answer string, agent_id string")
    qs = spark.createDataFrame([("Q001", "one", "e1", ["k1"]), ("Q002", "two", "e2", ["k2"])], "id string, question string, expected_answer string, source_chunks array<string>")
    per_run = built.withColumn("session_id", F.when(F.col("session_id") == "S2", "S2#2").otherwise(F.col("session_id")))
    checks = readers.summary_checks(mine)
    clips = spark.createDataFrame([], "session_id string, ord bigint, clip string")
    order = capture.played_order(per_run, checks, clips)
    resp = readers.read_artifacts(spark, str(root), "responses")
    ex = resp.select("session_id", F.posexplode("exchanges").alias("exch", "e")).select("session_id", F.col("exch").cast("bigint").alias("exch"), F.col("e.ours").alias("caller"), "e.reply")
    rep = resp.select("session_id", F.posexplode("replies").alias("i", "r")).select("session_id", (F.col("i") + 1).cast("bigint").alias("ord"), "r.responded", F.col("r.latencyMs").cast("bigint").alias("latency_ms"), F.col("r.latencyMsToFirstAudioChunk").cast("bigint").alias("first_audio_ms"))
    aligned = capture.align(readers.summary_transcript(mine).drop("file"), order, qs)
    heads = mine.select("session_id", F.col("agentId").alias("agent_id"), F.col("env.appUrl").alias("app_url"), "conversation_id")
    got = {(r["session_id"], r["turn"]): r for r in capture.capture_answers(heads, built, qs, checks=checks, exchanges=ex, replies=rep, turn_sources=readers.summary_sources(mine), aligned=aligned, order=order).collect()}
    assert {k: (r["question_id"], r["answer"], r["answered"], r["latency_ms"]) for k, r in got.items()} == {
        ("S1", 1): ("Q002", "second", True, 900), ("S1", 2): ("Q001", None, False, None), ("S2#2", 1): ("Q001", "told", True, 70)}
    assert got["S1", 2]["source_file_ids"] == ["f1", "f2"] and got["S2#2", 1]["agent_id"] == "own"
    assert got["S1", 1]["call_url"] == "https://app.test/en/agents/a/conversations/c1"


def test_stored_conversations(spark, tmp_path):
    put(tmp_path / "c.json", [
        {"id": "1", "createdAt": "2026-01-02T00:00:00Z", "recording_url": "u", "metadata": {"participant": {"ani": "tel:+9665"}}, "transcription": [{"role": "assistant", "content": " hi ", "startTime": 0.0, "end": 1.5}, {"speaker": "Customer", "message": "yes", "is_interrupted": True}]},
        {"id": "2", "createdAt": "2026-01-01T00:00:00Z", "metadata": {}, "transcription": []}])
    convs = readers.read_conversations(spark, str(tmp_path), lines=False)
    assert {r["conv_id"]: r["phone_number"] for r in readers.conversation_calls(convs).collect()} == {"1": "+9665", "2": None}
    assert [(r["speaker"], r["text"], r["start_s"], r["end_s"]) for r in readers.conversation_turns(convs).orderBy("ord").collect()] == [("assistant", "hi", 0.0, 1.5), ("customer", "yes", None, None)]
    assert readers.read_conversations(spark, str(tmp_path), since="2026-01-02", lines=False).count() == 1


def test_flow_files_to_sessions(spark, tmp_path):
    def scenario(flow, mode, lang):
        inc = mode == "incremental"
        return {"id": f"{flow}-{mode}", "flow_id": flow, "mode": mode, "language": lang, "question": f"{flow}?", "expected_answer": None if inc else "all", "chunk_ids": ["K1"],
                "steps": [{"step_n": n, "stimulus": f"{flow}{n}", "expected_answer": "a", "chunk_ids": ["K1", "gone"]} for n in (1, 2)] if inc else None}
    for flow in ("OPEN_ACCOUNT_A", "OPEN_ACCOUNT_B", "CLOSE"):
        put(tmp_path / "specs" / f"{flow}.json", {"flow_id": flow, "title": flow.title(), "chunks": [{"id": "K1", "text": "chunk one"}], "flows": [scenario(flow, m, l) for m in ("incremental", "full_dump") for l in ("ar", "en")]})
    put(tmp_path / "specs" / "none.json", {"flow_id": "X", "flows": []})
    put(tmp_path / "specs" / "bad.json", "{not json")
    specs = readers.read_flow_specs(spark, str(tmp_path / "specs"), lines=False)
    assert specs.count() == 3
    scen = readers.spec_scenarios(specs)
    q = questions.flows_to_questions(scen, readers.spec_chunks(specs).distinct())
    rows = {r["id"]: r for r in q.collect()}
    assert len(rows) == 18 and rows["CLOSE-INC-AR-002"]["source_chunks"] == ["chunk one"] and rows["CLOSE-DUMP-EN-001"]["pair_id"] == "CLOSE-FULL_DUMP"
    assert quality.validate_flows(scen).count() == 0
    flat = q.select(F.regexp_extract("sub_topic", "^(.*)-", 1).alias("base"), F.when(F.col("id").contains("-INC-"), "incremental").otherwise("fulldump").alias("mode"), "language",
                    F.regexp_extract("id", "(\\d+)$", 1).cast("bigint").alias("step"), "id", "question", "expected_answer")
    plan = sessions.auto_flow_plan(flat, 3)
    p = plan.first()
    assert plan.count() == 1 and len({p["first"], p["second"], p["third"]}) == 3
    turns = sessions.compose_flows(flat, "first", "second", "third", plan)
    assert {(r["session_id"], r["n"]) for r in turns.groupBy("session_id").agg(F.max("turn").alias("n")).collect()} == {("MultiFlow-ar-001", 5), ("MultiFlow-en-002", 5)}
    put(tmp_path / "replies" / "a.json", {"flows": [scenario("F1", "incremental", "ar")]})
    put(tmp_path / "replies" / "b.json", [scenario("F1", "full_dump", "ar")])
    put(tmp_path / "replies" / "c.json", scenario("F2", "full_dump", "en"))
    put(tmp_path / "replies" / "d.json", "oops")
    good, bad = readers.read_flow_replies(spark, str(tmp_path / "replies"))
    assert {(r["flow_id"], r["scenarios"]) for r in questions.merge_flows(good).collect()} == {("F1", 2), ("F2", 1)}
    assert [r["file"] for r in bad.collect()] == ["d.json"]


def test_article_chunks(spark):
    html = "<p> One <b>two</b></p><p> </p><table><tr><td>a</td><td> </td><td>b</td></tr><tr><td>a</td><td>b</td></tr></table><table><tr><th>مرحبا</th></tr></table><pre>no</pre>"
    got = [(r["id"], r["type"], r["text"], r["language"], r["grp"]) for r in kb.extract_chunks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("id").collect()]
    assert got == [("chunk_001", "paragraph", "One two", "en", None), ("chunk_002", "table_row", "a | b", "en", "table_0"), ("chunk_003", "table_row", "مرحبا", "ar", "table_1")]


def test_artifact_listing_and_transcript_files(spark, tmp_path):
    from convqa.operators.matching import newest_artifact

    for n in ("eval-results-2026-01-01T00-00-00-000Z-a.json", "eval-results-2026-01-02T00-00-00-000Z-a.json", "eval-results-zzz.json"):
        put(tmp_path / n, "[]")
    files = readers.artifact_files(spark, str(tmp_path), "eval-results-*.json").withColumn("k", F.lit(1))
    assert newest_artifact(files, ["k"]).first()["name"] == "eval-results-2026-01-02T00-00-00-000Z-a.json"
    put(tmp_path / "t" / "call7.txt", "AGENT: hello\nCUSTOMER: yes\n")
    assert [(r["conv_id"], r["speaker"]) for r in readers.read_labelled_transcripts(spark, str(tmp_path / "t")).orderBy("ord").collect()] == [("call7", "AGENT"), ("call7", "CUSTOMER")]


def test_prompt_and_payload_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"D{n}", f"text {n}") for n in range(10)], "n bigint, slug string, doc_text string")
    writers.write_prompts(kb.prompt_batches(docs, "n", "{count} documents", 8), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "manifest")).select(F.size("flows").alias("s")).orderBy("s").collect() == [(2,), (8,)]
    assert "2 documents" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "p" / "prompts")).collect())
    writers.write_payload(docs, str(tmp_path / "x"), "src", "judge it")
    assert spark.read.json(str(tmp_path / "x" / "header")).first()["instructions"] == "judge it"


CFG = CallConfig(settle_ms=5_000, confirm_ms=500, turn_timeout_ms=20_000)


def clock(events):
    out, c = [], fr.TurnClock(CFG)
    class Row:
        def __init__(self, at, kind, send_no, sentence):
            self.at, self.kind, self.send_no, self.sentence = at, kind, send_no, sentence
    fr._run_clock(c, [Row(*e) for e in events], out)
    last = c.flush()
    return out + ([last] if last else [])


def test_turn_clock_rules():
    assert clock([(0, "send", 1, None)]) == [(1, "", None, "timeout")]
    assert clock([(0, "send", 1, None), (700, "frame", 1, "a"), (5_600, "frame", 1, "b")]) == [(1, "a b", 700, "silence")]
    # a sentence inside the confirm window re-opens the answer, another frame there ends it
    assert clock([(0, "send", 1, None), (100, "frame", 1, "a"), (5_300, "frame", 1, "b"), (9_000, "frame", 1, "c")]) == [(1, "a b c", 100, "silence")]
    assert clock([(0, "send", 1, None), (100, "frame", 1, "a"), (5_300, "frame", 1, None), (5_400, "frame", 1, "late")]) == [(1, "a", 100, "silence")]
    # the limit of a waiting phase is not moved by frames
    assert clock([(0, "send", 1, None)] + [(n * 4_000, "frame", 1, str(n)) for n in range(1, 8)]) == [(1, "1 2 3 4 5", 4_000, "silence")]
    assert clock([(0, "send", 1, None), (100, "frame", 1, "a"), (2_000, "send", 2, None), (2_500, "frame", 2, "b")]) == [(1, "a", 100, "next-send"), (2, "b", 500, "silence")]


LOG = "session_id string, send_no bigint, at bigint, seq bigint, kind string, sentence string"


def test_exact_closing_batch_equals_stream(spark, tmp_path):
    import random

    rnd = random.Random(4)
    rows = []
    for s in range(8):
        at, seq = rnd.randint(0, 1000), 0
        for send in range(1, 5):
            rows.append((f"s{s}", send, at, seq, "send", None))
            for _ in range(rnd.randint(0, 5)):
                at += rnd.choice((200, 900, 4_900, 5_200))
                seq += 1
                rows.append((f"s{s}", send, at, seq, "frame", rnd.choice((None, "x", "y"))))
            at += 30_000
            seq += 1
    df = spark.createDataFrame(rows, LOG)
    want = sorted(map(tuple, fr.close_turns_batch(df, CFG).collect()), key=str)
    assert len(want) == 32
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low in range(0, 200_000, 40_000):  # five files in time order, plus one far ahead to move the watermark
        df.where(f"at >= {low} and at < {low + 40_000}").coalesce(1).write.mode("append").json(src)
        stream = fr.with_lateness(spark.readStream.schema(LOG).json(src).withColumn("ts", F.timestamp_millis("at")), "1 second")
        q = fr.close_turns_stream(stream, CFG).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.createDataFrame([("end", 1, 9_000_000, 0, "frame", None)], LOG).write.mode("append").json(src)
    for _ in range(2):
        fr.close_turns_stream(stream, CFG).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == want


FRAMES = "session_id string, send_no bigint, ts timestamp, seq bigint, sentence string, file_ids array<string>, loaded_files array<string>, play_id string, source_keys array<string>, saw_source_frame boolean"


def test_assembly_batch_equals_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"s{s}", n, 1_000 * (100 * n + 3 * k + s), 10 * n + k, f"w{k}" if k != 1 else None) for s in range(5) for n in range(0, 4) for k in range(3)]
    df = spark.createDataFrame(rows, "session_id string, send_no bigint, at bigint, seq bigint, sentence string").select("session_id", "send_no", F.timestamp_millis("at").alias("ts"), "seq", "sentence")
    df = df.select("*", F.array(F.col("sentence")).alias("file_ids"), F.lit(None).cast("array<string>").alias("loaded_files"), F.lit("p").alias("play_id"), F.array(F.lit("file_ids")).alias("source_keys"), F.lit(True).alias("saw_source_frame"))
    df.coalesce(1).write.json(src)
    for year in ("2030", "2031"):  # a batch emits what the watermark of the batch before has closed
        df.limit(1).withColumn("ts", F.lit(f"{year}-01-01").cast("timestamp")).withColumn("session_id", F.lit("end")).withColumn("send_no", F.lit(1).cast("bigint")).write.mode("append").json(src)
    cols = ["session_id", "send_no", "answer", "first_frame", "last_frame", "frames"]
    stream = fr.assemble(fr.with_lateness(fr.read_frames(spark, src, FRAMES, 1)), CFG).select(*cols)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, fr.assemble(df, CFG).select(*cols).collect()), key=str)
    assert sorted(map(tuple, spark.read.parquet(out).where("session_id <> 'end'").collect()), key=str) == want and len(want) == 15
    assert fr.answers(df).where("send_no = 1").first()["answer"] == "w0 w2"


def test_carry_and_align_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "session_id string, turn bigint, files array<string>, saw boolean"
    df = spark.createDataFrame([("s", 1, ["a"], True), ("s", 2, [], False), ("t", 1, ["b"], None)], schema)
    df.coalesce(1).write.json(src)
    def run(stream, name, mode="append"):
        out = str(tmp_path / f"{name}-out")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)
    run(fr.carry_sources_stream(spark.readStream.schema(schema).json(src)), "carry")
    spark.createDataFrame([("s", 3, [], False)], schema).write.mode("append").json(src)
    got = {(r["session_id"], r["turn"]): r["source_file_ids"] for r in run(fr.carry_sources_stream(spark.readStream.schema(schema).json(src)), "carry").collect()}
    assert got == {("s", 1): ["a"], ("s", 2): ["a"], ("s", 3): ["a"], ("t", 1): ["b"]}

    turns = spark.createDataFrame([("s", 0, "customer", "car loan rate"), ("s", 1, "agent", "five"), ("s", 2, "customer", "age limit"), ("s", 3, "agent", "sixty")], "session_id string, ord bigint, speaker string, text string")
    order = spark.createDataFrame([("s", 1, "q1"), ("s", 2, "q2")], "session_id string, pos bigint, question_id string")
    qs = spark.createDataFrame([("q1", "what is the car loan rate", ""), ("q2", "what is the age limit", "")], "id string, question string, expected_answer string")
    rows = capture.alignment_rows(turns, order, qs)
    end = rows.limit(1).withColumn("kind", F.lit(2)).withColumn("slot", F.lit(99).cast("bigint"))
    asrc = str(tmp_path / "align")
    rows.coalesce(1).write.json(asrc)
    run(fr.align_stream(spark.readStream.schema(rows.schema).json(asrc)), "align")
    end.write.mode("append").json(asrc)
    got = sorted((r["pos"], r["question"], r["answer"]) for r in run(fr.align_stream(spark.readStream.schema(rows.schema).json(asrc)), "align").collect())
    assert got == sorted((r["pos"], r["question"], r["answer"]) for r in capture.align(turns, order, qs).collect()) == [(1, "car loan rate", "five"), (2, "age limit", "sixty")]


def test_session_building_rules(spark):
    pool = spark.createDataFrame([(n, "T", "Sub A", "ar" if n < 23 else "en") for n in range(31)], "id bigint, topic string, sub_topic string, language string")
    built = sessions.build(pool, 10, 1)
    sizes = {r["session_id"]: (r["n"], r["d"]) for r in built.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d")).collect()}
    assert sizes == {"SubA-ar-001": (10, 10), "SubA-ar-002": (10, 10), "SubA-ar-003": (10, 10), "SubA-en-001": (8, 8)}
    assert sessions.uncovered(pool, built).isEmpty()
    quota = sessions.build_quota(pool, 4, 9, 1, reuse=True)
    assert quota.count() == 72 and all(r["ok"] for r in sessions.repeat_check(quota, pool).collect())
    assert {r["language"]: r["n"] for r in sessions.build_quota(pool, 4, 9, 1).groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()} == {"ar": 18}
    calls = spark.createDataFrame([(n, "ar" if n < 10 else "en") for n in range(30)], "session_id bigint, language string")
    picked = {r["language"]: r["n"] for r in sessions.sample_proportional(calls, 6, 4).groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert picked == {"ar": 2, "en": 4}
    assert reporting.manifest(pool).where("sub_topic is null").first()["total"] == 31
