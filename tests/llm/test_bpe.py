import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkdex.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_random_texts_equal_the_library(codec, library):
    rng = random.Random(4)
    codec.memo.limit = 100
    letters = "aeiouthernst '’\n\t ßäçé123.,!%%中文日本🙂 ΑΣς́İ\x1c\x85　​"
    texts = ["", "aaaaaaaaaaaaaaaaaaaaaaa", "%" * 999, " " * 300, "<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(4000)]
    for text, found in zip(texts, codec.encode_all(texts)):
        assert ids(found) == library.encode_ordinary(text), text
        assert codec.decode(found) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library(codec, library, text):
    assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(codec, library):
    rng = random.Random(5)
    v, whole = codec.vocabulary, lambda raw: library._core_bpe.encode_single_piece(raw)
    for trial in range(150):
        raw = bytes(rng.choice(b"thertionaeing. e") for _ in range(rng.randrange(1, 400)))
        state = bpe.Prefixes(v)
        cut = rng.randrange(len(raw))
        state.append(raw[:cut])
        state.append(raw[cut:])
        assert state.ids() == whole(raw)
        for _ in range(3):
            lo = rng.randrange(len(state.raw) + 1)
            hi = min(len(state.raw), lo + rng.randrange(6))
            new = bytes(rng.choice(b"thering e") for _ in range(rng.randrange(5)))
            want = state.raw[:lo] + new + state.raw[hi:]
            state.edit(lo, hi, new)
            assert state.raw == want and state.ids() == (whole(want) if want else []) and len(state.last) == len(want)


def test_edits_of_long_pieces_work_near_the_edit(codec):
    raw = b"thertionaeing" * 2000
    state = bpe.Prefixes(codec.vocabulary, raw)
    assert state.edit(10_000, 10_001, b"xy") < 2000


def test_documents(spark, library):
    rows = [(1, None), (2, ""), (3, "The the thé"), (None, "no id"), (3, "The the thé"), (4, "wor\nds " * 5000)]
    df = spark.createDataFrame([(k, t, b"x") for k, t in rows], "doc_id bigint, text string, ids binary")
    got = sorted(((r.doc_id, ids(r.ids), bytes(r.decoded)) for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted(((k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows), key=str)
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
