"""Flat flow steps, the nested documents written from them, composed sessions, and JSON files of either form."""

import json
from collections import defaultdict

import pytest

from convqa.operators import flows, questions, sessions
from convqa.sources import arrays, readers, writers

RECORD = "ord bigint, pair_id string, language string, topic string, sub_topic string, question string, expected_answer string, chunk_ids array<string>"


def records(n):
    """A third of all records belongs to one scenario of one flow."""
    out = []
    for k in range(n):
        hot = k % 3 == 0
        out.append((k, "p-DUMP" if not hot and k % 5 == 0 else "p-1", "ar" if hot else ["en", "fr", None][k % 3], "T", "Hot flow" if hot else ["F/1", "F:1", None, " "][k % 4],
                    f'ask "{k}"\n', f"say\t{k}" if k % 11 else None, ["c1"] if k % 2 else None))
    return out


def plain(rows):
    groups = defaultdict(list)
    for ord_, pair, lang, topic, sub, question, answer, chunks in sorted(rows):
        flow = sub if sub and sub.strip() else topic
        groups[flow, lang or "", "full_dump" if "dump" in (pair or "").lower() else "incremental"].append((question, answer, chunks or []))
    return groups


def test_steps_and_heads(spark):
    rows = records(500)
    numbered = flows.steps(spark.createDataFrame(rows, RECORD), block_rows=16)
    got = defaultdict(dict)
    for r in numbered.collect():
        got[r.flow_id, r.spoken, r.mode][r.step_n] = (r.question, r.expected_answer, r.chunk_ids)
    want = plain(rows)
    assert {k: [v[n] for n in sorted(v)] for k, v in got.items()} == want
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    heads = {(r.flow_id, r.spoken, r.mode): (r.question, r.steps) for r in flows.heads(numbered).collect()}
    assert heads == {k: (v[0][0], len(v)) for k, v in want.items()}


def test_no_row_and_no_task_state_holds_a_flow(spark):
    df = spark.createDataFrame(records(50), RECORD)
    for made in (flows.steps(df), flows.questions(flows.steps(df)), flows.spec_lines(flows.steps(df))):
        assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_nested_documents(spark, tmp_path):
    rows = records(3000)
    writers.write_flows(flows.steps(spark.createDataFrame(rows, RECORD)), str(tmp_path))
    files = list(tmp_path.glob("p_flow=*/*.txt"))
    docs = [json.loads(f.read_text()) for f in files]
    want = plain(rows)
    assert sorted(d["flow_id"] for d in docs) == sorted({k[0] for k in want}) and len(files) == 4
    for d in docs:
        seen = {}
        for s in d["flows"]:
            spoken = s["id"].rsplit("-", 1)[1].lower()
            if s["mode"] == "full_dump":
                seen[d["flow_id"], spoken, "full_dump"] = s["expected_answer"]
            else:
                assert [x["step_n"] for x in s["steps"]] == list(range(1, len(s["steps"]) + 1))
                seen[d["flow_id"], spoken, "incremental"] = [(x["stimulus"], x["expected_answer"], x["chunk_ids"]) for x in s["steps"]]
        assert seen == {k: " ".join(a or "" for _, a, _ in v) if k[2] == "full_dump" else v for k, v in want.items() if k[0] == d["flow_id"]}
    read = readers.spec_scenarios(readers.read_flow_specs(spark, str(tmp_path), lines=False, glob="*.txt"))
    assert read.count() == len(want)
    good, bad = readers.read_flow_replies(spark, str(tmp_path), "*.txt")
    assert questions.merge_flows(good).count() == 4 and bad.isEmpty()


def test_pieces_reach_the_file_in_the_order_of_the_sort(spark, tmp_path):
    """The writer adds no sort of its own, which could mix the pieces of a flow."""
    lines = flows.spec_lines(flows.steps(spark.createDataFrame(records(60), RECORD))).withColumn("p_flow", writers._file_name("flow_id"))
    assert not lines.schema["p_flow"].nullable


def test_flat_steps_round_trip(spark, tmp_path):
    numbered = flows.steps(spark.createDataFrame(records(300), RECORD))
    writers.write_flow_steps(numbered, str(tmp_path))
    back = readers.read_flow_steps(spark, str(tmp_path)).select(*numbered.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, numbered.collect()))


def test_composed_sessions(spark):
    rows = [(k, "x-dump" if k % 4 == 3 else "x", "en" if k % 2 else "ar", "T", f"flow{k % 5}", f"q{k}", f"a{k}", None) for k in range(400)]
    rows += [(1000 + k, "x-dump", "ar", "T", f"flow{k % 5}", f"q{k}", f"a{k}", None) for k in range(30)]
    flat = flows.questions(flows.steps(spark.createDataFrame(rows, RECORD)))
    base = flat.selectExpr("regexp_replace(sub_topic, '-(Incremental|FullDump)$', '') AS base", "if(id like '%-INC-%', 'incremental', 'fulldump') AS mode", "language", "step", "part", "id", "question", "expected_answer")
    plan = sessions.auto_flow_plan(base, 2)
    got = defaultdict(list)
    for r in sessions.compose_flows(base, "first", "second", "third", plan).collect():
        got[r.session_id].append((r.turn, r.part, r.question_id, r.expected_answer))
    chosen = plan.orderBy("session_no").collect()
    assert len(chosen) == 2
    want, texts = {}, plain(rows)
    number = 0
    for p in chosen:
        for lang in ("ar", "en"):
            parts = [texts.get((p[n], lang, m)) for n, m in (("first", "incremental"), ("second", "incremental"), ("third", "full_dump"))]
            if all(parts):
                number += 1
                turns = [(t + 1, 1, a) for t, (_, a, _) in enumerate(parts[0] + parts[1])]
                turns += [(len(turns) + 1, k + 1, a) for k, (_, a, _) in enumerate(parts[2])]
                want[f"MultiFlow-{lang}-{number:03d}"] = turns
    assert {s: sorted((t, p, a) for t, p, _, a in v) for s, v in got.items()} == want


def put(path, value, indent=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(v) for v in value) if indent == "lines" else json.dumps(value, indent=indent))


@pytest.mark.parametrize("indent", [None, 2, "lines"])
def test_every_form_is_read(spark, tmp_path, indent):
    asked = [{"id": f"Q{k}", "question": "why?\nso", "language": "en"} for k in range(5)]
    put(tmp_path / "q" / "T" / "A.json", asked, indent)
    put(tmp_path / "q" / "T" / "A.chunks.json", [{"id": "c", "text": "t"}], 2)
    put(tmp_path / "q" / "T" / "manifest.json", {"any": 1}, 2)
    put(tmp_path / "s" / "T" / "B.json", [{"session_id": f"s{k}", "messages": [{"turn": 1, "question_id": "Q1"}]} for k in range(3)], indent)
    put(tmp_path / "c" / "dump.json", [{"id": f"c{k}", "createdAt": "2026-01-01"} for k in range(4)], indent)
    put(tmp_path / "f" / "F1.json", {"flow_id": "F1", "flows": [{"id": "x", "mode": "full_dump"}]} if indent != "lines" else [{"flow_id": "F1", "flows": [{"id": "x"}]}], indent)
    got = readers.read_questions(spark, str(tmp_path / "q"))
    assert sorted(r.id for r in got.collect()) == [f"Q{k}" for k in range(5)] and got.first().question == "why?\nso"
    assert readers.session_turns(readers.read_sessions(spark, str(tmp_path / "s"))).count() == 3
    assert readers.read_conversations(spark, str(tmp_path / "c")).count() == 4
    assert readers.spec_scenarios(readers.read_flow_specs(spark, str(tmp_path / "f"))).first().id == "x"


def test_what_cannot_be_read_is_said(spark, tmp_path):
    put(tmp_path / "a" / "x.json", [{"id": "Q1"}], 2)
    put(tmp_path / "a" / "y.json", [{"id": "Q2"}, {"id": "Q3"}], "lines")
    with pytest.raises(ValueError, match="x.json"):
        readers.read_questions(spark, str(tmp_path / "a"))
    with pytest.raises(Exception, match="not a record of this kind"):
        readers.read_questions(spark, str(tmp_path / "a"), lines=True).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"id": "Q1"}\n{"id": "Q2"')
    with pytest.raises(Exception, match="not a record of this kind"):
        readers.read_questions(spark, str(tmp_path / "b")).collect()


def test_indented_replies_and_transcripts_are_read_whole(spark, tmp_path):
    put(tmp_path / "r" / "a.json", {"flows": [{"id": "x", "flow_id": "F", "mode": "full_dump"}, {"id": "y", "flow_id": "F"}]}, 2)
    put(tmp_path / "r" / "b.json", [{"id": "z", "flow_id": "G"}], 4)
    (tmp_path / "r" / "c.json").write_text("{\n no")
    good, bad = readers.read_flow_replies(spark, str(tmp_path / "r"))
    assert sorted(r.id for r in good.collect()) == ["x", "y", "z"] and [r.file for r in bad.collect()] == ["c.json"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("AGENT: hi\n\nCUSTOMER: yes\n2. BANK: so\n")
    got = readers.read_labelled_transcripts(spark, str(tmp_path / "t")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("one", 0, "AGENT", "hi"), ("one", 1, "CUSTOMER", "yes"), ("one", 2, "AGENT", "so")]


TRICKY = ['a "}" b', "]} , [{", '\\"}{', "\\\\", "é漢}字{", "", "}" * 30, '"', "line\nbreak }", "{[" * 5]


@pytest.mark.parametrize("indent", [None, 2])
def test_array_cut_at_braces(spark, tmp_path, indent):
    """Splits of some hundred bytes fall inside strings, characters and nested objects; every element comes out once."""
    rows = [{"id": f"r{k}", "text": TRICKY[k % len(TRICKY)] * (k % 4), "steps": [{"stimulus": TRICKY[(k * 3) % len(TRICKY)]}] * (k % 3)} for k in range(400)]
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps(rows[0]))
    (tmp_path / "three.json").write_text(json.dumps(rows[:2]) + "\n\n")
    (tmp_path / "four.json").write_text(json.dumps({"id": "last", "steps": [{"stimulus": "x"}]}) + "\n")
    (tmp_path / "none.json").write_text("[ ]\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700"), spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = arrays.read_json_array(spark, str(tmp_path), "id string, text string, steps array<struct<stimulus:string>>")
        assert arrays.pieces(spark, str(tmp_path), "one.json").rdd.getNumPartitions() > 20
        found = [(r.path.rsplit("/", 1)[1], r.id, r.text, tuple(s.stimulus for s in r.steps or ())) for r in got.collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = [("one.json", r["id"], r["text"], tuple(s["stimulus"] for s in r["steps"])) for r in rows] + [("two.json", "r0", "", ())]
    want += [("three.json", r["id"], r["text"], tuple(s["stimulus"] for s in r["steps"])) for r in rows[:2]] + [("four.json", "last", None, ("x",))]
    assert sorted(found, key=str) == sorted(want, key=str)
