import random

import numpy as np
import xxhash

from inkdex.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words)
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((key, f"{fps[i]:016x}", len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "été", "x", "delta.", "42", "日本"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "one two three")]
    base = [rng.choice(vocabulary) for _ in range(400)]
    for i in range(7, 60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(60, 90)] + [rows[-1], (7, rows[8][1])]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, fp string, anchor int")
    found = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert order(found) == order(brute(rows))
    assert any(r[2] > 3 for r in found)


def test_no_pair_within_two_bits_is_missed():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in (0, 1, 2):
        other = fp.copy()
        for _ in range(flips):
            other ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
        sets = []
        for x in (fp, other):
            rows, found = simhash.anchors(x.view(np.int64))
            sets.append([set(found[rows == i]) for i in range(300)])
        assert all(a & b for a, b in zip(*sets))
        assert max(map(len, sets[0])) <= 18


def test_long_text_is_hashed_in_chunks():
    text = " ".join(str(i % 977) for i in range(simhash.CHUNK + 5000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_planted_copies_and_keeping_one(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(300))
    rows = [(9, text), (4, text), (4, text), (6, text.replace("0.1", "0.1", 1)), (1, "quite another text altogether"), (None, text)]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id bigint, text string, lang string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, None]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_repeated_ids_with_other_texts_keep_one_row_of_each_component(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(str(rng.random()) for _ in range(400)) for _ in range(3))
    near = c.rsplit(" ", 1)[0] + " 0.5"
    assert 0 <= (brute_fingerprint(c) ^ brute_fingerprint(near)).bit_count() <= 2
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, near), (8, near), (3, ""), (3, None), (4, None)]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id bigint, text string, lang string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert sorted(k for k, _ in kept) == [1, 3, 5, 7]
    assert {(1, a), (5, b)} <= set(kept)
    many = [(k % 9, " ".join([*map(str, range(300)), str(k % 7)]) if k % 3 else str(rng.random())) for k in range(60)]
    df = spark.createDataFrame(many, "doc_id bigint, text string")
    component = {row: root for row, (_, _, _, root) in zip(many, brute([(k, t) for k, (_, t) in enumerate(many)]))}
    least = {root: min(k for (k, t), other in component.items() if other == root) for root in component.values()}
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted((component[row], row[0]) for row in kept) == sorted(least.items())
