import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkdex.llm import packing
from inkdex.llm.tokens import WordMemo

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aeioust THR'’\n\t\x0b\x1c\x85  ßäçÉ123.,!&日本🙂ΑΣς́İﬁ"


def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_memo_equals_the_library():
    rng, memo, library = random.Random(1), WordMemo(PATH), tokenizer()
    memo.limit = 50  # both halves of the memo are turned over
    specials = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "hello", " ", "é", "<|", "THE"]
    texts = ["", " ", "hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|><|endoftext|>", "it's we'll THEY'D"]
    texts += ["".join(rng.choice(specials) for _ in range(rng.randrange(8))) for _ in range(500)]
    assert memo.encode(b"hello <|endoftext|> world") == np.array([3306, 49407, 1002], "<u4").tobytes()
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(memo.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(memo) <= 50 and len(memo.old) <= 50


def best_fit(counts, capacity):
    """Sequences that best-fit decreasing opens, one piece at a time."""
    gaps, opened = [0] * (capacity + 1), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                opened, gap = opened + 1, capacity
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return opened


def test_sweep_places_every_rank_once_and_fills_no_sequence_twice():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 2048):
        for kinds in (0, 1, 5, 300):
            counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(kinds)}
            ranks, fill = defaultdict(list), defaultdict(list)
            for length, lo, hi, first, offset in packing.sweep(counts, capacity):
                ranks[length] += range(lo, hi)
                for k in range(hi - lo):
                    fill[first + k].append((offset, length))
            assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
            for parts in fill.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(fill) <= 1.01 * best_fit(counts, capacity) + 1
            assert sorted(fill) == list(range(len(fill)))


def test_pack_documents(spark):
    rng, library = random.Random(3), tokenizer()
    words = ["the", "of", "Erreth", "123", "été", "x."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 200, 900])))) for k in range(300)]
    rows += [(300, None), (301, ""), (None, "no id"), (5, rows[5][1]), (302, "the " * 32), (303, "the " * 31)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, length int, piece int")
    capacity = 32
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(key, n, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes()))
                 for n, at in enumerate(range(0, len(ids), capacity))]
    got = packing.pack_documents(df, PATH, capacity=capacity).collect()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
    assert order([tuple(r)[:5] for r in got]) == order(want)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) <= 1.02 * -(-sum(r[3] for r in want) // capacity) + 1


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "the first one"), (2, "the second"), (3, "third " * 30)], "doc_id bigint, text string")
    placed = packing.pack_documents(df, PATH, capacity=16)
    pieces = {(r.doc_id, r.piece): bytes(r.ids) for r in packing.encode(df, PATH, 16).collect()}
    packed = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed, packing.encode(df, PATH, 16)).collect()}
    for r in placed.collect():
        assert packed[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == pieces[r.doc_id, r.piece]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
