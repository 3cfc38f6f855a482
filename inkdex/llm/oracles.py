"""SQL for DuckDB that states what the corpus operators compute, where SQL can, from the tables alone."""

from __future__ import annotations

from inkdex.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
M64 = "18446744073709551616::UHUGEINT"
SPACE = r" \t-\r"


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _times(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {M64})"


def _shifted(a: str, by: int) -> str:
    """A number below 2^64 with its own bits, shifted down, laid over it."""
    return f"xor(({a})::UHUGEINT, ({a})::UHUGEINT // {1 << by}::UHUGEINT)"


def shards(n: int, row_bytes: int = 16) -> str:
    """Jump consistent hashing of doc_id, with checksums byte by byte and slots in the order of doc_id."""
    first = f"((doc_id::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT"
    mixed = [("z0", f"({first}) % {M64}", "documents")]
    for k, (by, factor) in enumerate(((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 1):
        mixed.append((f"z{k}", _times(_shifted(f"z{k - 1}", by), factor), f"m{k - 1}"))
    steps = ",\n".join(f"m{k} AS (SELECT *, {value} AS {name} FROM {source})" for k, (name, value, source) in enumerate(mixed))
    return f"""WITH RECURSIVE {steps},
keyed AS (SELECT doc_id, {_shifted('z2', 31)} AS key FROM m2),
jump(doc_id, key, here, next) AS (
  SELECT doc_id, key, -1::BIGINT, 0::BIGINT FROM keyed
  UNION ALL SELECT doc_id, k, next, floor((next + 1) * (2147483648::DOUBLE / ((k // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, next, ({_times('key', 2862933555777941757)} + 1::UHUGEINT) % {M64} AS k FROM jump WHERE next <= {n})),
home AS (SELECT doc_id, max(next) FILTER (next < {n}) AS shard, max(next) FILTER (next <= {n}) AS grown_shard FROM jump GROUP BY doc_id),
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
crc AS (SELECT doc_id, octet_length(b) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295) AS c FROM raw)
SELECT doc_id, (size + {row_bytes})::BIGINT AS size, c::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM crc JOIN home USING (doc_id)"""


def repeats(length: int) -> str:
    """Every window of every text, counted by its MD5."""
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + {length - 1}]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {length - 2})) AS i FROM d)),
often AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN often USING (h)),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS lo, max(i) + {length} AS hi FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS since FROM span UNION ALL
  SELECT doc_id, octet_length(b) + 1, coalesce((SELECT max(hi) FROM span s WHERE s.doc_id = d.doc_id), 1) FROM d),
kept AS (SELECT doc_id, string_agg(CASE WHEN lo > since THEN hex(b[since:lo - 1]) ELSE '' END, '' ORDER BY lo) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""


def license_phrases() -> str:
    """What :data:`inkdex.llm.licenses.PHRASES` finds."""
    places, labels = [], []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        fits = " AND ".join(f"words[i + {n}] = '{w}'" for n, w in enumerate(words))
        places.append(f"list_filter(range(1, len(words) - {len(words) - 2}), lambda i: {fits}) AS \"{label}\"")
        labels.append(f"CASE WHEN len(\"{label}\") > 0 THEN '{label}' END")
    names = [f'"{x}"' for x in licenses.PHRASES.values()]
    every = names[0]
    for n in names[1:]:
        every = f"list_concat({every}, {n})"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, {', '.join(places)} FROM w),
a AS (SELECT *, {every} AS places FROM p)
SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a"""


def features(min_words: int, max_repeated: int, gram: int) -> str:
    """The counted features of the quality rules."""
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{SPACE}]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i:i + {gram - 1}] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {gram - 2})) AS i FROM w)),
often AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, g HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {gram})) AS p FROM often) GROUP BY doc_id),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN inside USING (doc_id))
SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeated} * n_words AS base_failed FROM f"""


def neighbours(k: int, every: int) -> str:
    """The nearest vectors by comparing each query with all."""
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
fine AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, e.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM fine q JOIN fine e ON q.vec_id <> e.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= {k}"""
