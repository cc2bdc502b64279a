import random

import pyarrow as pa
import pytest

from tidemark.llm import tokens as T

pytest.importorskip("ahocorasick")
RAW = open(f"{T.TOKENIZER_FOLDER}/{T.RANKS}", "rb").read()
TEXTS = ["", None, "a" * 20_000, "é" * 3000, " \n\t  x", "😀" * 500, "0" * 9999, "abc<|endoftext|>d", "\x1c\x85\xa0 z", "don't WE'RE I'll", "plain ascii  text\r\n\r\n next\x0b", "ZWJ‍ ﬁ İ ß", "限定クーポン 无料 Привет مرحبا", "\x00\x01\x7f", "   "]


def oracle():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.read_ranks(RAW), special_tokens={})


def test_equals_merges_by_rank():
    enc, split = T.BytePairEncoder(T.read_ranks(RAW)), T.splitter()
    rng, ref = random.Random(2), oracle()
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x10000, 0x1FFFF), 10, 32])) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts += ["".join(rng.choice("aeioust nhrl") for _ in range(400)).replace(" ", rng.choice(["", " "])) for _ in range(100)]
    flat, off = T.encode_texts(enc, split, pa.array(texts))
    for i, s in enumerate(texts):
        assert list(flat[off[i] : off[i + 1]]) == (ref.encode_ordinary(s) if s else []), s
    assert T.count_texts(enc, split, pa.array(texts)) == [off[i + 1] - off[i] for i in range(len(texts))]


def test_round_trip_of_bytes():
    enc = T.BytePairEncoder(T.read_ranks(RAW))
    rng = random.Random(4)
    for _ in range(300):
        raw = bytes(rng.randrange(256) for _ in range(rng.randint(1, 60))).decode("latin-1")
        assert "".join(enc.text[i] for i in enc.piece(raw)) == raw


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 3)
    enc, split, ref = T.BytePairEncoder(T.read_ranks(RAW)), T.splitter(), oracle()
    s = "some words that repeat, some words that don't repeat at all"
    flat, _ = T.encode_texts(enc, split, pa.array([s, s]))
    assert list(flat) == ref.encode_ordinary(s) * 2 and len(enc.cache) <= 3


def test_query(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")], "doc_id long, text string, ids string")
    ref = oracle()
    got = T.token_ids(df).collect()
    assert len(got) == len(TEXTS) + 1 and T.token_ids(df.limit(0)).count() == 0
    for r in got:
        assert r["ids"] == (ref.encode_ordinary(TEXTS[r["doc_id"]]) if TEXTS[r["doc_id"]] else [])
