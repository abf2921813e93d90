"""The pipeline's rows against a plain model built from the operators' own contracts."""

import random
from collections import defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline
from convqa.llm import pseudonyms
from test_jaccard_join import plain
from test_mixing import plain_targets

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r.doc_id: r for r in corpus_pipeline.rules(spark, docs, SF).collect()}
    assert 0 < len(clean) <= docs.count()
    groups = plain([(k, r.text) for k, r in clean.items()], words=5, percent=80)
    left = {k: r for k, r in clean.items() if groups[k][1] == k}
    texts = {k: pseudonyms.replace_private(r.text, corpus_pipeline.KEY)[0] for k, r in left.items()}
    size = defaultdict(int)
    for k, t in texts.items():
        size[left[k].source] += len(t.split())
    target = plain_targets(size)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    taken = defaultdict(int)
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in rows:
        assert r.ids == lib.encode(texts[r.doc_id]) + [2] and r.n_tokens == len(r.ids)
        taken[r.source] += len(texts[r.doc_id].split())
    for s in size:
        longest = max(len(texts[k].split()) for k in texts if left[k].source == s)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1e-6


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    line = "Some plain words that make a line of good length here, ending well. "
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, line * 1, "en", None, 5), (3, line * 1, "en", None, 5), (4, " ".join(f"w{i}" for i in range(30_000)) + ".", None, "t", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert corpus_pipeline.pieces(spark, docs, SF).count() >= 0


def test_near_copies_at_80_percent_of_5_words(spark):
    rng = random.Random(4)
    rows = []
    for k, more in enumerate((85, 90, 96, 104, 120)):
        base = [f"w{k}x{i}" for i in range(400)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + [f"y{k}x{i}" for i in range(more)]))]
    for k in range(100, 160):
        words = [f"z{k // 4}x{i}" for i in range(rng.choice([40, 200]))]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"q{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect())
    assert got == sorted(k for k, (_, first) in plain(rows, words=5, percent=80).items() if k == first)
    assert not {1, 11, 21} & set(got) and 41 in got


def test_near_copies_without_or_with_equal_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    rows = [(1, one), (2, two), (2, one + " more"), (3, three), (3, three), (None, three), (None, two + " more"), (None, "alone " * 3), (None, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    want = [(1, one), (2, two), (3, three), (None, "alone " * 3), (None, None), (4, None), (4, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mix_of_rows_without_or_with_equal_ids(spark):
    """Three rows in four have no id or the same one; each is taken on its own, so no source passes its target by more than a text."""
    rows = [(None if k % 4 == 0 else 7 if k % 4 < 3 else k, f"word{k} and more words", "en", "ab"[k % 5 == 0], 1) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = plain_targets({"a": 4 * 1600, "b": 4 * 400})
    got = defaultdict(int)
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        got[r.source] += 4
    assert all(abs(got[s] - target[s]) <= 2 for s in target)
