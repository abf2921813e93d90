import io
import random
import wave
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convqa.config import AudioConfig, CallConfig
from convqa.operators import audio, kb, matching, provenance


def test_asof_conversation_cases(spark):
    calls = spark.createDataFrame([(1, "a", 100_000), (2, "b", 100_000), (3, "c", 100_000), (4, "d", 5)], "call_id int, agent_id string, started_ms bigint")
    convs = spark.createDataFrame([(10, "a", 90_000), (11, "a", 102_000), (20, "b", 90_000), (30, "c", 10)], "conv_id int, agent_id string, created_ms bigint")
    got = {r["call_id"]: (r["conv_id"], r["match"]) for r in matching.asof_conversation(calls, convs).collect()}
    assert got == {1: (11, "after"), 2: (20, "skew"), 3: (30, "fallback"), 4: (None, "none")}


def test_content_match_equals_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{n}" for n in range(40)]
    texts = [rnd.choices(vocab, k=rnd.randint(1, 12)) for _ in range(25)]
    texts += [texts[0]] * 15  # a third of the calls say the same
    live = {c: list(t) if rnd.random() < 0.5 else t[: max(1, len(t) - 2)] + rnd.choices(vocab, k=1) for c, t in enumerate(texts)}
    start = {c: rnd.randint(0, 200_000) for c in live}
    made = {c: start[c] + rnd.choice((-20_000, -5_000, 0, 3_000, 90_000)) for c in live}
    agent = {c: c % 2 for c in live}
    def turns(source):
        return spark.createDataFrame([(c, n, s, t) for c, words in source.items() for n, (s, t) in enumerate((("agent", "hello there"), ("customer", " ".join(words))))], "conv_id int, ord bigint, speaker string, text string")
    calls = spark.createDataFrame([(c, agent[c], start[c]) for c in live], "call_id int, agent_id int, started_ms bigint")
    convs = spark.createDataFrame([(c, agent[c], made[c]) for c in live], "conv_id int, agent_id int, created_ms bigint")
    got = {r["call_id"]: r["conv_id"] for r in matching.match_by_content(calls, turns(live), convs, turns(dict(enumerate(texts))), block_width=1_000).collect()}
    cfg = CallConfig()
    def dice(a, b):
        return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))
    for c in live:
        cands = sorted((abs(made[v] - start[c]), v) for v in live if agent[v] == agent[c] and made[v] >= start[c] - cfg.call_match_skew_ms)
        best, best_sim = None, -1.0
        for _, v in cands:
            s = dice(live[c], texts[v])
            if s > best_sim:
                best, best_sim = v, s
            if s >= cfg.transcript_match_min:
                break
        assert got[c] == (best if best_sim >= cfg.conv_match_min else None), c


def test_artifact_priority(spark):
    res = spark.createDataFrame([("s1", "2026-01-01T00-00-00-000Z", "c1"), ("s2", "2026-01-01T00-00-00.123Z", ""), ("s3", "2026-01-01T00-00-00-000Z", "c9")], "session_id string, run_stamp string, conversation_id string")
    art = spark.createDataFrame([
        ("s1", "summary-a.json", "a", "c1"), ("s1", "summary-z.json", "z", "c2"), ("s2", "summary-2026-01-01T00-00-00-999Z.json", "2026-01-01T00-00-00-999Z", None), ("s2", "summary-2027.json", "2027", None),
        ("s3", "summary-1.json", "1", None), ("s3", "summary-2.json", "2", None)], "session_id string, file string, stamp string, conversation_id string")
    got = {r["session_id"]: (r["file"], r["match"]) for r in matching.match_artifacts(res, art, True).collect()}
    assert got == {"s1": ("summary-a.json", "conversation"), "s2": ("summary-2026-01-01T00-00-00-999Z.json", "stamp"), "s3": ("summary-2.json", "newest")}
    assert {r["session_id"]: r["match"] for r in matching.match_artifacts(res, art, False).collect()}["s3"] == "none"


def test_document_pairs_equal_sequential_rule(spark):
    rnd = random.Random(12)
    for trial in range(4):
        n_ar, n_en = rnd.randint(5, 25), rnd.randint(5, 25)
        manual = {f"a{n}": f"e{rnd.randint(1, n_en + 3)}" for n in rnd.sample(range(1, n_ar + 1), rnd.randint(0, n_ar))}
        used, want = set(), {}
        for n in range(1, n_ar + 1):
            m = manual.get(f"a{n}")
            options = [m if m and int(m[1:]) <= n_en else None, f"e{n}" if n <= n_en else None]
            want[f"a{n}"] = pick = next((x for x in options if x and x not in used), None)
            used.add(pick)
        ar = spark.createDataFrame([(n, f"a{n}") for n in range(1, n_ar + 1)], "idx bigint, file string")
        en = spark.createDataFrame([(n, f"e{n}") for n in range(1, n_en + 1)], "idx bigint, file string")
        table = spark.createDataFrame(list(manual.items()) or [("", "")], "ar string, en string")
        rows = kb.pair_documents(ar, en, table).collect()
        assert {r["ar_file"]: r["en_file"] for r in rows if r["ar_file"]} == want
        assert {r["en_file"] for r in rows if not r["ar_file"]} == {f"e{n}" for n in range(1, n_en + 1)} - used


def test_carry_forward_rules(spark):
    df = spark.createDataFrame([("s", 1, ["a"], None), ("s", 2, [], False), ("s", 3, [], True), ("s", 4, None, False), ("s", 5, ["b"], True), ("t", 1, [], False)], "session_id string, turn bigint, files array<string>, saw boolean")
    got = {(r["session_id"], r["turn"]): r["source_file_ids"] for r in provenance.carry_forward(df, 2).collect()}
    assert got == {("s", 1): ["a"], ("s", 2): ["a"], ("s", 3): [], ("s", 4): [], ("s", 5): ["b"], ("t", 1): []}


def model_runs(db, voiced, cfg):
    threshold = max(np.percentile(db, cfg.noise_floor_percentile) + cfg.margin_db, cfg.min_speech_dbfs)
    loud = [n for n, x in enumerate(db) if x > threshold]
    runs = []
    for n in loud:
        if runs and n - runs[-1][1] <= cfg.hangover_frames:
            runs[-1][1] = n + 1
        else:
            runs.append([n, n + 1])
    return {(s, e, round(float(np.mean(voiced[s:e])), 9)) for s, e in runs if e - s >= cfg.min_speech_frames}


@pytest.mark.parametrize("block", [5, 64, 100_000])
def test_speech_runs_and_overlap(spark, block):
    cfg = AudioConfig()
    rnd = np.random.default_rng(3)
    rows, want = [], {}
    for call in ("x", "y"):
        for ch in (0, 1):
            level = np.repeat(rnd.choice([-70.0, -20.0], 60), rnd.integers(1, 16, 60))[:300]
            db, voiced = level + rnd.normal(0, 2, len(level)), rnd.random(len(level)) < 0.5
            want[call, ch] = model_runs(db, voiced, cfg)
            rows += [(call, ch, n, float(d), bool(v)) for n, (d, v) in enumerate(zip(db, voiced))]
    frames = spark.createDataFrame(rows, "call string, channel int, frame bigint, db double, voiced boolean")
    runs = audio.speech_runs(frames, cfg, block)
    got = {k: set() for k in want}
    for r in runs.collect():
        got[r["call"], r["channel"]].add((r["start"], r["end"], round(r["voiced_share"], 9)))
    assert got == want
    segs = {k: set() for k in [(c, n) for c in "xy" for n in ("energy", "voiced")]}
    for r in audio.overlap_segments(runs, cfg, block).collect():
        segs[r["call"], r["net"]].add((r["start"], r["end"]))
    for call in "xy":
        for net, least in (("energy", -1), ("voiced", cfg.min_voiced_ratio)):
            a, b = (set(f for s, e, v in want[call, ch] if v >= least for f in range(s, e)) for ch in (0, 1))
            out = []
            for f in sorted(a & b):
                if out and f - out[-1][1] <= cfg.merge_gap_frames:
                    out[-1][1] = f + 1
                else:
                    out.append([f, f + 1])
            assert segs[call, net] == {tuple(x) for x in out}


def wav(seconds, tones, rate=8000, width=2):
    t = np.arange(int(seconds * rate)) / rate
    data = np.zeros((len(t), len(tones)))
    for ch, spans in enumerate(tones):
        for a, b, hz in spans:
            on = (t >= a) & (t < b)
            data[on, ch] += sum(0.1 * np.sin(2 * np.pi * hz * k * t[on]) / k ** 0.5 for k in range(1, 8)) if hz < 300 else 0.3 * np.sin(2 * np.pi * hz * t[on])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(tones)), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes((data * 30000).astype("<i2").tobytes() if width == 2 else bytes(len(t)))
    return out.getvalue()


def test_recordings_end_to_end(spark, tmp_path):
    from convqa.session import materialize
    from convqa.sources.readers import read_recordings
    from convqa.sources.writers import write_interruption_csv

    voices = [[(0.5, 4.0, 120)], [(2.0, 6.0, 180)]]
    horn = [[(0.5, 4.0, 450)], [(2.0, 6.0, 180)]]
    polite = [[(0.5, 2.0, 120)], [(3.0, 6.0, 180)]]
    for name, tones in (("talkover", voices), ("horn", horn), ("polite", polite), ("mono", [[(1, 2, 120)]])):
        (tmp_path / f"{name}.wav").write_bytes(wav(8, tones))
    (tmp_path / "bad.wav").write_bytes(wav(1, [[]], width=1))
    (tmp_path / "junk.wav").write_bytes(b"not a wav")
    f = materialize(audio.frames(read_recordings(spark, str(tmp_path))))
    calls = f.groupBy("call").agg(F.max("frame_s").alias("frame_s"), F.max("duration_s").alias("duration_s"), F.max("error").alias("error"))
    stats = audio.overlap_stats(audio.overlap_segments(audio.speech_runs(f.where("error is null"))))
    results = audio.classify_calls(calls, stats)
    got = {r["file"]: r for r in results.collect()}
    assert {k: v["confidence"] for k, v in got.items()} == {"talkover": "high", "horn": "low", "polite": "", "mono": "high" if got["mono"]["longest_overlap_s"] >= 1 else "", "bad": "", "junk": ""}
    assert got["talkover"]["longest_overlap_s"] == pytest.approx(2.0, abs=0.1) and got["talkover"]["longest_overlap_start_s"] == pytest.approx(2.0, abs=0.1)
    assert "16-bit" in got["bad"]["error"] and got["junk"]["error"] and got["horn"]["duration_s"] == 8.0
    rated = results.withColumn("phone_number", F.when(F.col("file") != "polite", "055")).select("*", *[F.lit(1).alias(c) for c in ("exchange_count", "failed_high", "failed_low", "interruptions_handled")])
    rates = audio.call_rates(rated).first()
    assert (rates["web_excluded"], rates["calls"], rates["low"], rates["errors"]) == (1, 5, 1, 2)
    write_interruption_csv(rated, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns[:4] == ["file", "duration_s", "is_bug", "confidence"]


def test_heavy_token_lists_are_met_in_blocks(spark):
    """One agent holds most contents and all of them share words; split lists give the pairs of whole ones, and all of them."""
    rnd = random.Random(9)
    def side(prefix, n):
        bags = {}
        for k in range(n):
            words = rnd.choices(["the", "of", "and"] + [f"w{x}" for x in range(25)], k=rnd.randint(4, 12))
            bags[("hot" if k % 6 else "cold", f"{prefix}{k}")] = {w: words.count(w) for w in words}
        return bags
    left, right = side("l", 90), side("r", 90)
    frame = lambda bags: spark.createDataFrame([(a, s, sum(b.values()), t, n) for (a, s), b in bags.items() for t, n in b.items()], "agent_id string, sig string, size bigint, token string, n bigint")
    want = set()
    for (a, s), x in left.items():
        for (b, t), y in right.items():
            both = sum(min(n, y.get(w, 0)) for w, n in x.items())
            if a == b and 2 * both / (sum(x.values()) + sum(y.values())) >= 0.6:
                want.add((a, s, t, round(2 * both / (sum(x.values()) + sum(y.values())), 9)))
    for limit in (40, 10**9):
        got = matching.similar_contents(frame(left), frame(right), 0.6, limit).collect()
        assert {(r.agent_id, r.sig, r.other, round(r.sim, 9)) for r in got} == want and len(got) == len(want) > 20
