"""Counts against the tokenizer itself and against files written by hand."""

import random

import numpy as np
import public_tokenizers

from convqa.llm import token_files
from convqa.llm.q_text import token_counts


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    encode = token_files.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    want = sorted((r.doc_id, len(encode(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, token_counts(spark, sf).collect())) == want


def test_blocks_of_any_size(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c", "y"), (3, "a b c", "y"), (None, "w " * 5000, None), (5, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").coalesce(2)
    make = lambda: lambda t: [ord(c) for c in t]
    want = sorted(((k or -1, len(t or "")) for k, t, _ in rows))
    for block in (1, 2, 7, 100, 1 << 20):
        got = token_files.count(df, make, end_id=0, block_tokens=block).collect()
        assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    assert token_files.count(df.limit(0), make, end_id=0).count() == 0


def test_flat_files(spark, tmp_path):
    rng, want = random.Random(4), []
    for f in range(3):
        lengths = [rng.choice([0, 1, 5, 400]) for _ in range(20)]
        stream = [x for n in lengths for x in [7] * n + [9]] + [7] * f
        np.array(stream, dtype="<u4").tofile(tmp_path / f"{f}.bin")
        want += [(f, k, n, True) for k, n in enumerate(lengths)] + ([(f, 20, f, False)] if f else [])
    (tmp_path / "9.bin").write_bytes(b"")
    got = token_files.documents(token_files.scan(token_files.read_flat(spark, str(tmp_path), width=4, block_tokens=64), 9, width=4)).collect()
    assert sorted((int(r.file[-5]), r.place, r.n_tokens, r.closed) for r in got) == sorted(want)
