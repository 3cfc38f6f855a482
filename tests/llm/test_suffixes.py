import random
from collections import Counter

import numpy as np
import pytest

from inkdex.llm import suffixes


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def found(spark, rows, length, **more):
    df = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id bigint, text string, at int, owner string")
    return [(r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(df, length, **more).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def corpus(seed, length, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé ") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(length // 3 + rng.randrange(length // 3)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "z" * (3 * length)), (3, "z" * length), (4, "ab" * length), (5, "y" * (length - 1)), (6, "y" * (length - 1))]
    for i in range(7, n):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            at = rng.randrange(len(p) // 2)
            p = p[at : at + rng.randrange(length // 2, len(p))]
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, text(rng.randrange(20))]
        rows.append((i, " ".join(parts)))
    return rows + [rows[-1], rows[-2], (n, rows[-3][1]), (None, rows[-4][1])]


@pytest.mark.parametrize("length,crowd", [(200, 20_000), (200, 1), (24, 20_000), (40, 2)])
def test_against_brute_force(spark, length, crowd):
    rows = corpus(length + crowd, length)
    want = brute(rows, length)
    assert sum(r[2] for r in want) > 1000 and any(0 < r[2] < r[1] for r in want)
    assert order(found(spark, rows, length, crowd=crowd)) == order(want)


def test_texts_longer_than_a_stretch(spark, monkeypatch):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh") for _ in range(500))
    long = "".join(rng.choice("ijklmnop") for _ in range(suffixes.STRETCH + 1000))
    at = suffixes.STRETCH - 250
    rows = [(1, long[:at] + shared + long[at:]), (2, "start " + shared + " end"), (3, long[:100] + shared[:150])]
    got = {r[0]: r[1:4] for r in found(spark, rows, 200)}
    assert got == {1: (len(rows[0][1]), 500, 1), 2: (len(rows[1][1]), 500, 1), 3: (250, 0, 0)}


def test_merge_equals_sorting_all_windows():
    rng = random.Random(8)
    for trial in range(30):
        length = rng.choice([8, 25, 30, 50])
        bodies = ["".join(rng.choice("ab") for _ in range(rng.randrange(length, 3 * length))).encode() for _ in range(rng.randrange(1, 9))]
        bodies += bodies[: rng.randrange(3)]
        seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        for b, flags in zip(bodies, suffixes.repeated(bodies, length)):
            assert flags.tolist() == [seen[b[i : i + length]] > 1 for i in range(len(b) - length + 1)]


def test_texts_made_to_collide_lose_nothing(spark):
    """Sums of byte times power of a fixed base that are equal modulo 2^64, for unequal strings."""
    rng = random.Random(4)
    p, q = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150)) for _ in range(2))
    made = "PQPPPPPRTTRPRPSRPQRP", "QPSQPTQPPPPPPRPPPPPS"
    sums = {sum((b + 1) * pow(suffixes.BASE, k, 2**64) for k, b in enumerate(x.encode())) % 2**64 for x in made}
    assert len(sums) == 1  # the fast hash does collide here
    texts = [p + x + q for x in made]
    rows = [(n, t) for n, t in enumerate(texts)]
    for crowd in (suffixes.CROWD, 1):
        assert {(r[1], r[2]) for r in found(spark, rows, 200, crowd=crowd)} == {(320, 0)}
    for body, flags in zip(texts, suffixes.repeated([t.encode() for t in texts], 200)):
        assert not flags.any()
    got = suffixes.repeated([t.encode() for t in [*texts, texts[0]]], 200)
    assert got[0].all() and got[2].all() and not got[1].any()


def test_symbols_are_told_apart_by_bytes():
    rng = random.Random(5)
    for q in (1, 3, 8, 13, 25):
        raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
        full = np.arange(400) <= 400 - q
        want = [raw[i : i + q].tobytes() for i in range(400 - q + 1)]
        for hashes in (np.where(full, np.array([hash(x) % 3 for x in want] + [0] * (q - 1), dtype=np.uint64), np.uint64(0)),):
            codes = suffixes._symbols(raw, full, hashes, q)
            assert len(set(zip(want, codes.tolist()))) == len(set(want)) == len(set(codes[: len(want)].tolist()))
            assert not set(codes[len(want) :].tolist()) & set(codes[: len(want)].tolist())


def test_many_equal_rows_take_linear_time(spark):
    """Rows without an id that hold one text: their spans are listed once, not once for each row."""
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows = [(None, text)] * 3000 + [(1, "start " + text[500:900] + " end"), (2, "x" * 100)]
    got = found(spark, rows, 200)
    assert sorted({r[:4] for r in got}, key=str) == sorted({(None, 2000, 2000, 1), (1, 410, 402 if text[499] == " " and text[900] == " " else 401 if " " in (text[499], text[900]) else 400, 1), (2, 100, 0, 0)}, key=str)
    assert len(got) == 3002


def test_segments_own_every_window_once():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 5000, dtype=np.uint8).tobytes()
    at, n, _, _ = suffixes.segments(text, 200)
    assert at[0] == 0 and (at[1:] == (at + n)[:-1]).all() and at[-1] + n[-1] == 5000 - 200 + 1


def test_empty_table(spark):
    assert found(spark, [], 200) == []
