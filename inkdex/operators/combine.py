"""OR, AND and AND_NOT over words and nested queries, as expressions over one row for each document."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkdex.options import CombineWith


@dataclass(frozen=True)
class Part:
    """Whether a document matches, with what score, and by which words (places; null where a word isn't used)."""

    present: Column
    score: Column
    places: tuple[Column, ...]


def nothing() -> Part:
    return Part(F.lit(False), F.lit(0.0), ())


def word(place: int) -> Part:
    own = F.col(f"__s{place}")
    return Part(own.isNotNull(), F.coalesce(own, F.lit(0.0)), (F.when(own.isNotNull(), F.lit(place)),))


def _if(present: Column, score: Column, places) -> Part:
    return Part(present, F.when(present, score).otherwise(0.0), tuple(F.when(present, p) for p in places))


def combine(parts: list[Part], how: CombineWith) -> Part:
    """Left fold; without parts nothing matches."""
    if not parts:
        return nothing()
    if len(parts) == 1:
        return parts[0]
    if how is CombineWith.AND_NOT:
        others = reduce(lambda a, b: a | b, [p.present for p in parts[1:]])
        return _if(parts[0].present & ~others, parts[0].score, parts[0].places)
    total = reduce(lambda a, b: a + b, [p.score for p in parts])
    places = [p for part in parts for p in part.places]
    if how is CombineWith.OR:
        return Part(reduce(lambda a, b: a | b, [p.present for p in parts]), total, tuple(places))
    return _if(reduce(lambda a, b: a & b, [p.present for p in parts]), total, places)
