"""SQL for DuckDB that states what the search queries compute, from the tables alone."""

from __future__ import annotations

DEFAULT_TOKEN = r"[^\n\r\p{Z}\p{P}]+"
JOBBOARD_TOKEN = r"[\p{L}\p{M}\p{N}+#.]+"
# DuckDB's edit distance counts bytes: other letters are mapped to capitals, which terms don't hold
LETTERS = ("äßçèéêíñóöüáàâîïôûúùëœæìò", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(column: str) -> str:
    return f"translate({column}, '{LETTERS[0]}', '{LETTERS[1][: len(LETTERS[0])]}')"


def corpus(table: str, key: str, fields: list[str], where: str = "true", pattern: str = DEFAULT_TOKEN, term: str = "lower(t)", keep: str = "term <> ''") -> str:
    """Common tables: d (documents), len, post, stats, n, df and terms."""
    each = " UNION ALL ".join(
        f"SELECT id, {n} AS field, regexp_extract_all(f{n}, {literal(pattern)}) AS toks FROM d WHERE f{n} IS NOT NULL" for n in range(len(fields)))
    columns = ", ".join(f"{f} AS f{n}" for n, f in enumerate(fields))
    return f"""
d AS (SELECT {key} AS id, {columns} FROM {table} WHERE {where}),
tok AS ({each}),
len AS (SELECT id, field, len(list_distinct(toks)) AS len FROM tok),
post AS (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, unnest({"list_transform(toks, lambda t: " + term + ")" if term != "*" else "toks"}) AS term FROM tok) WHERE {keep} GROUP BY ALL),
stats AS (SELECT field, avg(len) AS avg FROM len GROUP BY field),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
df AS (SELECT term, field, count(*)::DOUBLE AS df FROM post GROUP BY ALL),
terms AS (SELECT DISTINCT term, length(term)::DOUBLE AS size FROM post)"""


def hits(words: list[tuple], boosts: dict[int, float], k: float = 1.2, b: float = 0.7, d: float = 0.5, prefix_weight: float = 0.375, fuzzy_weight: float = 0.45) -> str:
    """Common tables: spec (the words: term, prefix, distance, boost), found (weights) and hit (contributions)."""
    values = ", ".join(
        f"({n}, {literal(w[0])}, {'true' if len(w) > 1 and w[1] else 'false'}, {w[2] if len(w) > 2 else 0}, {float(w[3]) if len(w) > 3 else 1.0}::DOUBLE)" for n, w in enumerate(words))
    fields = ", ".join(f"({n}, {float(v)}::DOUBLE)" for n, v in boosts.items())
    edits = f"levenshtein({plain('t.term')}, {plain('s.word')})"
    return f"""
spec(qi, word, prefix, most, boost) AS (VALUES {values}),
fb(field, fboost) AS (VALUES {fields}),
found AS (SELECT * FROM (SELECT s.qi, s.word, s.boost, t.term, t.size, CASE
  WHEN t.term = s.word THEN 1.0::DOUBLE
  WHEN s.prefix AND starts_with(t.term, s.word) THEN {prefix_weight}::DOUBLE * t.size / (t.size + 0.3::DOUBLE * (t.size - length(s.word)))
  WHEN s.most > 0 AND abs(t.size - length(s.word)) <= s.most AND {edits} BETWEEN 1 AND s.most THEN {fuzzy_weight}::DOUBLE * t.size / (t.size + {edits})
  END AS weight FROM terms t, spec s) WHERE weight IS NOT NULL),
hit AS (SELECT p.id, f.qi, f.word, f.term, p.field,
  f.weight * f.boost * fb.fboost * ln(1 + (n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))
  * ({d}::DOUBLE + p.tf * ({k}::DOUBLE + 1) / (p.tf + {k}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l.len / st.avg))) AS s
  FROM post p JOIN found f USING (term) JOIN df ON df.term = p.term AND df.field = p.field JOIN fb ON fb.field = p.field
  JOIN len l ON l.id = p.id AND l.field = p.field JOIN stats st ON st.field = p.field, n)"""


def combined(words: list[tuple], how: str = "or") -> str:
    """Common table res(id, score) by OR, AND or AND_NOT."""
    n = len(words)
    quality = "count(DISTINCT word)"
    if how == "or":
        return f"res AS (SELECT id, sum(s) * {quality} AS score FROM hit GROUP BY id)"
    if how == "and":
        return f"res AS (SELECT id, sum(s) * {quality} AS score FROM hit GROUP BY id HAVING count(DISTINCT qi) = {n})"
    return "res AS (SELECT id, sum(s) AS score FROM hit GROUP BY id HAVING max(qi) = 0)"


def search(table: str, key: str, fields: list[str], words: list[tuple], boosts: dict[int, float] | None = None, how: str = "or",
           out: str = "", where: str = "true", corpus_options: dict | None = None, **parameters) -> str:
    """A search whose result is (key, score), or ``out`` over res and hit."""
    boosts = {n: 1.0 for n in range(len(fields))} if boosts is None else boosts
    out = out or f"SELECT id AS {key}, round(score, 6) AS score FROM res"
    return f"WITH {corpus(table, key, fields, where, **(corpus_options or {}))},{hits(words, boosts, **parameters)},\n{combined(words, how)}\n{out}"
