import json
import random

from convqa.sources import readers, replies

TEXTS = ['plain words', 'a "quoted" {brace} [x]', 'back\\slash \\" "', '"', '', 'مرحبا "بك"', 'steps', '"steps": [{', 'line\nbreak\ttab', '\\']


def reply(rnd, form):
    def scenario(n):
        made = {"id": f"S{n}", "flow_id": f"F{rnd.randint(0, 2)}", "question": rnd.choice(TEXTS), "language": "en"}
        if rnd.random() < 0.5:
            made["steps"] = [{"step_n": k + 1, "stimulus": rnd.choice(TEXTS), "expected_answer": rnd.choice(TEXTS), "chunk_ids": ["c"] * rnd.randint(0, 2)} for k in range(rnd.randint(0, 6))]
        else:
            made["expected_answer"] = rnd.choice([None, " ".join(rnd.choices(TEXTS, k=12))])
        return dict(rnd.sample(list(made.items()), len(made)))

    some = [scenario(n) for n in range(rnd.randint(1, 4))]
    return {"flows": some, "chunks": [{"id": "k", "text": rnd.choice(TEXTS)}], "flow_id": "R"} if form == 0 else some if form == 1 else some[0]


def test_cut_replies_equal_whole_ones(spark, tmp_path):
    """However the scan cuts the files, scenarios, steps, answers and unreadable files are those of the parser that holds a file whole."""
    rnd = random.Random(5)
    for n in range(9):
        (tmp_path / f"r{n}.json").write_text(json.dumps(reply(rnd, n % 3), ensure_ascii=n % 2 == 0, indent=n % 4 or None), encoding="utf-8")
    good = json.dumps({"flows": [{"id": "a", "flow_id": "F", "steps": [{"step_n": 1, "stimulus": "x"}, {"step_n": 2}]}]})
    odd = {"cut": good[:-2], "tail": good + '"', "more": good + "x", "twice": good + good, "step": good.replace('"step_n": 1', '"step_n": '), "comma": good.replace("}, {", "} {"), "shut": good.replace("2}", "2]"),
           "escape": '{"id": "a", "flow_id": "F", "expected_answer": "a\\q b"}', "open": '{"id": "a', "none": "", "text": '"just"', "number": "12", "null": '{"flows": null, "id": "n"}', "blank": " \n"}
    for name, text in odd.items():
        (tmp_path / f"odd-{name}.json").write_text(text)
    whole, lost = readers.read_flow_replies(spark, str(tmp_path))
    want = {(r["file"], r["id"]): r for r in whole.collect()}
    lost = sorted(r["file"] for r in lost.collect())
    assert len(lost) >= 9 and len(want) > 12
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (150, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            scenarios, bad = replies.read_reply_scenarios(spark, str(tmp_path))
            rows = scenarios.collect()
            assert sorted(r["file"] for r in bad.collect()) == lost, size
            assert {(r["file"], r["id"]): (r["flow_id"], r["question"], r["language"], r["n_steps"]) for r in rows} == {
                k: (r["flow_id"], r["question"], r["language"], None if r["steps"] is None else len(r["steps"])) for k, r in want.items()}, size
            steps, answers = {}, {}
            for r in replies.read_reply_steps(spark, str(tmp_path)).orderBy("place").collect():
                steps.setdefault((r["path"], r["scenario"]), []).append((r["step_n"], r["stimulus"], r["expected_answer"], r["chunk_ids"]))
            for r in replies.read_reply_answers(spark, str(tmp_path)).orderBy("start", "n").collect():
                answers.setdefault((r["path"], r["scenario"]), []).append(r["text"])
            for r in rows:
                w, at = want[r["file"], r["id"]], (r["path"], r["scenario"])
                assert steps.get(at, []) == [(x["step_n"], x["stimulus"], x["expected_answer"], x["chunk_ids"]) for x in w["steps"] or []], (size, r)
                assert "".join(answers.get(at, [])) == (w["expected_answer"] or ""), (size, r)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
