import random

import public_tokenizers
import pytest
import tiktoken

from inkdex.llm import attribution
from inkdex.llm.bpe import read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(fields, lines, rule):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    owner, names = [], []
    for n, (name, text) in enumerate(fields):
        text = (text or "") + ("\n" if n + 1 < len(fields) else "")
        pieces = [text]
        if name in lines:
            cut = (fields[n][1] or "").split("\n")
            pieces = [x + "\n" for x in cut[:-1]] + [cut[-1] + text[len(fields[n][1] or "") :]]
        for k, piece in enumerate(pieces):
            names.append(f"{name}:{k}" if name in lines else name)
            owner += [len(names) - 1] * len(piece)
    whole = "".join((t or "") + ("\n" if n + 1 < len(fields) else "") for n, (_, t) in enumerate(fields))
    chars = [n for n, c in enumerate(whole) for _ in c.encode()]  # character of each byte
    tokens, crossing, at = [0] * len(names), [0] * len(names), 0
    ids = library.encode_ordinary(whole)
    for i in ids:
        size = len(library.decode_single_token_bytes(i))
        own = [owner[c] for c in sorted(set(chars[at : at + size]))]
        at += size
        tokens[{"first": own[0], "last": own[-1], "majority": min(set(own), key=lambda s: (-own.count(s), s))}[rule]] += 1
        if len(set(own)) > 1:
            for s in set(own):
                crossing[s] += 1
    bounds = [sum(o < k for o in owner) for k in range(len(names) + 1)]
    return [(n, bounds[k], bounds[k + 1], tokens[k], crossing[k], len(ids)) for k, n in enumerate(names)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_against_brute_force(spark, rule):
    rng = random.Random(12)
    letters = "aeth \n\n\n\n é日🙂.,12"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    rows = [(0, None, None, None), (1, "", "", ""), (2, "a", None, "\n\n\n\n"), (3, " \n", "  ", "   x\n\n   \n")]
    rows += [(k, text(rng.randrange(4)), text(3), text(rng.randrange(60))) for k in range(4, 80)] + [(None, "s", "en", "x\ny"), (1, "", "", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, lang string, text string, section int")
    got = attribution.count_tokens(df, PATH, public_tokenizers.PATTERN, ["source", "lang", "text"], ("text",), rule=rule).collect()
    want = [(r[0], *x) for r in rows for x in brute(list(zip(["source", "lang", "text"], r[1:])), ("text",), rule)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.n_crossing for r in got)


def test_rules_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert attribution.count_tokens(df, PATH, public_tokenizers.PATTERN, ["text"]).collect() == []
    with pytest.raises(ValueError):
        attribution.count_tokens(df, PATH, public_tokenizers.PATTERN, ["text"], rule="none")
