import zlib
from collections import Counter

import numpy as np

from inkdex.llm import sharding


def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def brute_mix(x):
    z = (x + 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def test_jump_equals_brute_force_and_moves_rows_only_into_the_new_shard():
    keys = sharding.mix(np.arange(3000, dtype=np.uint64))
    assert keys.tolist() == [brute_mix(k) for k in range(3000)]
    before = None
    for shards in range(1, 45):
        now = sharding.jump(keys, shards)
        assert now.tolist() == [brute_jump(int(k), shards) for k in keys]
        if before is not None:
            moved = now != before
            assert (now[moved] == shards - 1).all() and abs(moved.mean() - 1 / shards) < 0.03
        before = now


def test_documents(spark):
    rows = [(k, f"text {k % 7}" * (k % 5)) for k in range(500)] + [(500, None), (501, "é"), (None, "x"), (None, None), (7, "text 0"), (7, "text 0"), (-3, "neg"), (2**60, "big")]
    df = spark.createDataFrame([(k, t, 9, 9) for k, t in rows], "doc_id bigint, text string, shard int, size int")
    got = sharding.assign(df, 40).collect()
    want = Counter()
    for key, text in rows:
        raw, k = (text or "").encode(), brute_mix((sharding.NULL_KEY if key is None else key) % 2**64)
        want[key, len(raw) + 16, zlib.crc32(raw), "key", brute_jump(k, 40), brute_jump(k, 41)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for shard in range(40):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(df.limit(0), 40).collect() == []
