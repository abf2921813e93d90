"""Line rules case by case, counts against a plain model, and the defined results."""

import random
import re
import time

from convqa.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_counts(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 12, "é b ü|*\x0b\x0c c", "l\nl\n l\n\nl"]
    texts += ["".join(rng.choice(["a ", "b ", "cc ", "d\n", "# ", "é! "]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in q.clean(df).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_line_rules(spark):
    good = "This line says something whole and ends as a sentence should."
    cases = {
        good: None, 'He said "enough." ': None, "no end here": "punctuation", "a long running line, with commas and twelve or more words in it that wraps on": None,
        "AND!! THE!! OF!! IT!! WAS!!": "punctuation", "of%%% the&&& re*** is$$$.": "punctuation", "home » news » sport » login.": "navigation", "Skip to content.": "navigation",
        "All rights reserved.": "boilerplate", "Licensed under the Apache License, Version 2.0.": "boilerplate", "": None,
    }
    text = "\n".join(cases)
    got = q.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = {n: sum(v == n for v in cases.values()) for n in ("punctuation", "navigation", "boilerplate")}
    assert dict(got.failed_lines) == want
    assert got.cleaned == "\n".join(line for line, rule in cases.items() if rule is None)
    assert got.lost_chars == sum(len(re.sub(r"\s", "", line)) for line, rule in cases.items() if rule)


def test_edges(spark):
    line = "Some plain words that make a line of good length here, ending well."
    rows = [(1, None, "x", 1), (2, line + "\nno\nend\nhere", None, 2), (2, line + "\nno\nend\nhere", None, 2), (3, " ".join(f"word{k}" for k in range(30_000)) + ".", "y", 3), (None, "short", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = q.clean(df).collect()
    assert [r.kept for r in out] == [False, True, True, True, False] and out[1] == out[2] and out[3].n_words == 30_000
    assert out[0].cleaned == "" and out[1].cleaned == line and out[1].text.endswith("here")
    assert q.clean(df.limit(0)).count() == 0


def splits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(")


def test_filter_does_not_copy_the_rules(spark):
    """A filter on the verdict leaves the plan as it is, so one long text with repeated lines takes a moment, not minutes."""
    text = "\n".join("Some plain words that make a line of good length here, ending well." for _ in range(8_000)) + "\n" + " ".join(f"w{k}" for k in range(40_000)) + "."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    out = q.clean(df)
    assert splits(out.where("kept")) == splits(out) < 8
    start = time.perf_counter()
    assert [r.doc_id for r in out.where("not kept").collect()] == [1, 2]
    assert q.clean(df, made=("cleaned", "kept")).where("kept").columns == ["doc_id", "text", "cleaned", "kept"]
    assert time.perf_counter() - start < 10
