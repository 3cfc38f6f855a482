import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkdex.llm import masked_lm
from inkdex.llm.masked_lm import DIGITS, PAD, SPACE

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute_windows(library, text):
    c = [PAD, *library.encode(text or "", add_special_tokens=False).ids, PAD]
    return [tuple(c[i : i + 3]) for i in range(len(c) - 2)]


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["thing", "Other", "der", "und", "42", "été"]
    follow = {w: rng2.sample(words, 2) for w in words for rng2 in [random.Random(w)]}
    out = [None, "", "a"]
    for _ in range(n):
        line = [rng.choice(words)]
        for _ in range(rng.randrange(1, 40)):
            line.append(rng.choice(follow[line[-1]]))
        out.append(" ".join(line))
    return out


def test_windows_and_histogram(spark, library):
    texts = corpus(1, 40) + ["x " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = masked_lm.encoded(df, PATH, "doc_id", "text")
    want = Counter(w for t in texts for w in brute_windows(library, t))
    got = {}
    for r in masked_lm.histogram(tokens).collect():
        near, middle = masked_lm.split(np.array([r.code]))
        got[int(near[0, 0]), int(middle[0]), int(near[0, 1])] = r.n
    assert got == want
    code, starts = masked_lm.windows([np.array([5, 6], np.uint32), np.zeros(0, np.uint32), np.array([7], np.uint32)])
    assert starts.tolist() == [0, 2, 2, 3]
    assert code.tolist() == [(a * SPACE + b) * SPACE + c for a, b, c in ((PAD, 5, 6), (5, 6, PAD), (PAD, 7, PAD))]


def test_probabilities_sum_to_one():
    net, rng = masked_lm.Network(3), np.random.default_rng(4)
    for name, a in net.w.items():
        a += rng.normal(0, 0.2, a.shape).astype(np.float32)
    every = (np.full(SPACE, 11, np.int64) * SPACE + np.arange(SPACE)) * SPACE + 12
    assert np.exp(net.log_p(every).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_equals_differences():
    net, rng = masked_lm.Network(counts=np.arange(SPACE) % 7), np.random.default_rng(2)
    net.w = {k: w.astype(np.float64) + rng.normal(0, 0.1, w.shape) for k, w in net.w.items()}
    code = rng.integers(0, SPACE**3, 20)
    code[5] = code[6]
    near, middle = masked_lm.split(code)
    near[3] = near[4, 0]
    weight = rng.random(20)
    loss = lambda: -(weight * net.forward(near, middle)[3]).sum()
    for name, g in net.gradient(near, middle, weight).items():
        w = net.w[name]
        for _ in range(8):
            if name in net.SPARSE:
                row = rng.integers(0, len(g[0]))
                column = rng.integers(0, w.shape[1])
                at, mine = (g[0][row], column), g[1][row, column]
            else:
                at = tuple(rng.integers(0, s) for s in w.shape)
                mine = g[at]
            was = w[at]
            w[at] = was + 1e-5
            up = loss()
            w[at] = was - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(mine, abs=1e-5)
            w[at] = was


def test_held_out_texts_are_predicted(spark, library):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(corpus(3, 600))], "doc_id bigint, text string")
    net = masked_lm.train(masked_lm.histogram(masked_lm.encoded(df, PATH, "doc_id", "text")), parts=2, rounds=4)
    held = [t or "" for t in corpus(4, 60)]
    rows = [(k, t) for k, t in enumerate(held)] + [(None, "und der"), (7, held[7]), (900, None), (901, "qXz&zq|Xjq"), (902, "der und " * 20_000)]
    tokens = masked_lm.encoded(spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, n_tokens int"), PATH, "doc_id", "text")
    got = masked_lm.score(tokens, net).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((k, len(brute_windows(library, t))) for k, t in rows)
    for r in got:
        code = np.array([(a * SPACE + b) * SPACE + c for a, b, c in brute_windows(library, dict(rows)[r.doc_id])], np.int64)
        assert r.sum_log_p == pytest.approx(float(net.log_p(code).astype(float).sum()), rel=1e-4, abs=1e-6)
        assert (r.mean_log_p is None) == (r.n_tokens == 0)
    tokens = Counter(w[1] for t in held for w in brute_windows(library, t))
    total = sum(tokens.values())
    unigram = sum(n * math.log(n / total) for n in tokens.values()) / total
    own = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    mine = sum(r.sum_log_p for r in own) / sum(r.n_tokens for r in own)
    assert mine > unigram * 0.75  # neighbours on both sides tell more than frequencies
    assert next(r.mean_log_p for r in got if r.doc_id == 901) < 2 * mine


def test_a_fit_does_not_depend_on_how_rows_are_spread(spark):
    """Tokens that one part alone has seen keep all it learnt of them."""
    assert DIGITS**3 == SPACE
    rows = [((PAD * SPACE + 5) * SPACE + 6, 10), ((5 * SPACE + 6) * SPACE + PAD, 10)]
    net = masked_lm.train(spark.createDataFrame(rows, "code bigint, n bigint"), parts=4, rounds=1)
    first = masked_lm.Network(counts=np.bincount([5, 6], weights=[10, 10], minlength=SPACE))
    moved = np.flatnonzero((net.w["embed"] != first.w["embed"]).any(axis=1))
    assert set(moved.tolist()) == {5, 6, PAD}
    assert np.exp(net.log_p(np.array([r[0] for r in rows]))).min() > np.exp(first.log_p(np.array([r[0] for r in rows]))).min()


def test_empty_table(spark):
    assert masked_lm.score_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
