"""Text analysis as column expressions; all stay in generated code but the lambdas of custom analyzers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line ends, Unicode separators and punctuation part tokens; tabs and symbols don't.
DEFAULT_TOKEN = r"[^\n\r\p{Z}\p{P}]+"
#: For job advertisements: letters, digits and the marks in names such as c++, c# and node.js.
JOBBOARD_TOKEN = r"[\p{IsAlphabetic}\p{N}+#.]+"


def default_tokens(c: Column) -> Column:
    """Tokens in order, none empty."""
    return F.regexp_extract_all(c, F.lit(DEFAULT_TOKEN), F.lit(0))


def jobboard_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(JOBBOARD_TOKEN), F.lit(0))


def default_terms(tokens: Column) -> Column:
    """Terms of tokens: Unicode lower case."""
    return F.transform(tokens, F.lower)


def jobboard_terms(tokens: Column) -> Column:
    """Lower case without dots at the end."""
    return F.transform(tokens, lambda t: F.rtrim(F.lower(t), F.lit(".")))


def each(function) -> "callable":
    """A term processor from a function of one token: it gives a term, null to drop it, or an array to expand it."""

    def process(tokens: Column) -> Column:
        return F.transform(tokens, function)

    return process


def expand(function):
    """A term processor from a function of one token that gives an array of terms."""

    def process(tokens: Column) -> Column:
        return F.flatten(F.transform(tokens, function))

    return process


def without_empty(terms: Column) -> Column:
    return F.filter(terms, lambda t: t.isNotNull() & (t != ""))


def stringify(c: Column, kind: T.DataType) -> Column:
    """Text of any value: arrays are joined by commas with nulls empty, structures are a fixed mark."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return F.when(c.isNotNull(), F.array_join(F.transform(c, lambda x: F.coalesce(stringify(x, inner), F.lit(""))), ","))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.lit("[object Object]"))
    return c.cast("string")


def field_length(tokens: Column) -> Column:
    """Number of distinct tokens, counted before any processing."""
    return F.size(F.array_distinct(tokens))


def runs(terms: Column) -> Column:
    """(term, tf) of each distinct term of a sorted column, which must be an attribute: it is looked up again and again."""
    starts = F.array_compact(F.transform(terms, lambda t, n: F.when((n == 0) | (t != F.get(terms, n - 1)), n)))
    each = lambda at: F.transform(at, lambda a, n: F.struct(F.get(terms, a).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(terms)) - a).cast("bigint").alias("tf")))
    return F.get(F.transform(F.array(starts), each), F.lit(0))
