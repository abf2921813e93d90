"""The piece coder against the library, on fixed cases, random texts and the driver's documents."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from convqa.llm import sentencepiece_bpe
from convqa.llm.q_text import sentencepiece as query

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.PieceCoder.load(MODEL)


CASES = ["", " ", "  ", "a", " a", "a ", "  a  b ", "\n\t x", "</s> <s> <unk> <0x41>", "▁x ▁▁y", "é漢字 😀 ​́", "aaaaaaaaaaaaaaaaaaaaaaa" * 9, " " * 77 + "the" + " " * 40,
         "=" * 100, "-" * 37, "naïve façade", "\x00\x01", "hello  world   foo    bar     baz", "ofthethethe" * 40, "▁"]


def test_cases(pair):
    lib, own = pair
    for t in CASES:
        assert own.encode(t) == lib.encode(t), t
        assert own.coded(t)[1] == lib.decode(lib.encode(t)) == own.decode(lib.encode(t)), t


def test_random(pair):
    lib, own = pair
    rng = random.Random(3)
    alphabets = ["ab ", "aeiou thnrs", "=-# \n", " ▁x", "éèçàß ñó the", "0123456789., ", "ТУФхцчшж ия", "漢字かな😀 a", "()[]{};:\n  if"]
    for _ in range(3000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 60)))
        assert own.encode(t) == lib.encode(t), repr(t)
        assert own.coded(t)[1] == lib.decode(lib.encode(t)), repr(t)


def test_operator_keeps_columns(spark, pair):
    lib, _ = pair
    rows = [(1, None, "x"), (2, "", None), (3, "the  same", "y"), (3, "the  same", "y"), (None, "word " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepiece_bpe.encode(df, MODEL).collect()
    assert len(out) == 5 and out[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in out:
        assert r.ids == lib.encode(r.text or "") + [2] and r.decoded == lib.decode(lib.encode(r.text or ""))
    assert sentencepiece_bpe.encode(df.limit(0), MODEL).count() == 0


def test_query(spark, pair):
    lib, _ = pair
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in query(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id]) + [2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_work_and_memory_of_remembered_chunks(pair):
    """Words with marks and line ends behind them share the entry of the bare word, and an entry holds ids alone."""
    lib, _ = pair
    own = sentencepiece_bpe.PieceCoder.load.__wrapped__(MODEL)
    words = [a + b + c for a in ("stom", "lanti", "erho") for b in ("ver", "ung", "tion") for c in ("ble", "keit", "mos")]
    text = " ".join(w + end for w in words for end in ("", ",", ".", "!!", ".\nThe", "&&&", "42"))
    assert own.encode(text) == lib.encode(text) and own.coded(text)[1] == lib.decode(lib.encode(text))
    assert len(own.chunks) < 2 * len(words) and all(isinstance(v, bytes) for v in own.chunks.values())
    assert not own.pairs  # short chunks are merged, so no pairs are kept


def test_long_runs_and_full_caches(pair, monkeypatch):
    lib, _ = pair
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 7)
    own = sentencepiece_bpe.PieceCoder.load.__wrapped__(MODEL)
    rng = random.Random(8)
    for n in (23, 24, 25, 26, 60, 700):
        for letters in ("etaoinshr", "нарикоег", "=-#();", "漢字数据获取一个", "aé\U0001f600н1=", "a ▁\n"):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert own.encode(t) == lib.encode(t) and own.coded(t)[1] == lib.decode(lib.encode(t)), t
    assert len(own.chunks) <= 7 and len(own.older) <= 7


def test_kinds_part_no_piece(pair):
    """No piece holds characters of two kinds, so no merge reaches over a cut."""
    _, own = pair
    for p in own.ids:
        assert len(own.split(p.replace(sentencepiece_bpe.SPACE, " "))) == 1, p


def test_bytes_decode_as_the_library_does(pair):
    lib, own = pair
    for t in ("\x00\x7f", "\u20bf😀😀", "𝒜b\nc", "\ufffd", "\U0010ffff\u0301"):
        ids = lib.encode(t)
        assert own.decode(ids) == lib.decode(ids) == t
