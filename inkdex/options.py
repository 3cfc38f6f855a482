"""Options of an index and of a search; ``None`` means unset and falls back to the index's defaults."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column

from inkdex.functions import text as analysis


class CombineWith(Enum):
    OR = "or"
    AND = "and"
    AND_NOT = "and_not"

    @classmethod
    def parse(cls, value: "str | CombineWith") -> "CombineWith":
        if isinstance(value, cls):
            return value
        try:
            return cls(str(value).lower())
        except ValueError:
            raise ValueError(f"Invalid combination operator: {value}") from None


@dataclass(frozen=True)
class Bm25:
    """``k`` term saturation, ``b`` length normalization, ``d`` the floor of BM25+."""

    k: float = 1.2
    b: float = 0.7
    d: float = 0.5


@dataclass(frozen=True)
class Weights:
    """Weights of terms that match by edit distance and by prefix; an exact match weighs 1."""

    fuzzy: float = 0.45
    prefix: float = 0.375


Fuzzy = bool | float | Callable[[str, int, list[str]], Any] | None
Prefix = bool | Callable[[str, int, list[str]], bool] | None


@dataclass(frozen=True)
class SearchOptions:
    """How a query is matched, scored and combined.

    ``prefix``, ``fuzzy`` and ``boost_term`` may be functions of (term, place, all
    terms).  ``filter`` is a condition on the id and stored columns; N and the
    document frequencies stay those of the whole index.  ``boost_document`` is
    a function of the id and term columns that may also use stored columns; its
    value multiplies each contribution, and null or zero drops it.
    """

    fields: tuple[str, ...] | None = None
    boost: dict[str, float] | None = None
    prefix: Prefix = None
    fuzzy: Fuzzy = None
    max_fuzzy: int | None = None
    combine_with: CombineWith | str | None = None
    weights: Weights | None = None
    bm25: Bm25 | None = None
    filter: Column | None = None
    boost_document: Callable[[Column, Column], Column] | None = None
    boost_term: Callable[[str, int, list[str]], float] | None = None
    tokenize: Callable[[Column], Column] | None = None
    process_term: Callable[[Column], Column] | None = None

    def over(self, base: "SearchOptions", overwrite: bool = False) -> "SearchOptions":
        """These options, with what is unset taken from ``base``.

        ``overwrite`` takes only ``fields``, a ``boost`` that isn't set and a ``fuzzy``
        that isn't set from ``base``; all else falls to the library's defaults.
        """
        cascade = {"fields", "boost", "fuzzy"} if overwrite else {f.name for f in fields(self)}
        mine = {f.name: getattr(self, f.name) for f in fields(self)}
        if mine["boost"] == {}:
            mine["boost"] = None
        return SearchOptions(**{k: getattr(base, k) if v is None and k in cascade else v for k, v in mine.items()})

    def resolved(self) -> "SearchOptions":
        """No field unset but those for which unset has a meaning of its own."""
        return replace(
            self,
            prefix=False if self.prefix is None else self.prefix,
            fuzzy=False if self.fuzzy is None else self.fuzzy,
            max_fuzzy=6 if self.max_fuzzy is None else self.max_fuzzy,
            combine_with=CombineWith.parse("or" if self.combine_with is None else self.combine_with),
            weights=self.weights or Weights(),
            bm25=self.bm25 or Bm25(),
        )


def max_distance(term: str, fuzzy: bool | float | None, limit: int) -> int:
    """Greatest edit distance for a term: a share of its length below 1, and a number of edits from 1 on."""
    if fuzzy is True:
        fuzzy = 0.2
    if not fuzzy or fuzzy < 0:
        return 0
    return min(limit, math.floor(len(term) * fuzzy + 0.5)) if fuzzy < 1 else int(fuzzy)


@dataclass(frozen=True)
class IndexOptions:
    """What is indexed and how.

    A null is a missing field unless ``null_as_empty``: a missing field has no
    length and leaves the field's average alone, an empty one has length 0.
    ``extract`` maps field names to columns that are computed from a document.
    ``auto_vacuum`` rewrites the index in a discard that leaves enough dead documents
    (``min_dirt_count`` and ``min_dirt_factor``).  ``running_removal`` takes removed documents out
    of the running averages one by one instead of averaging what is left.
    """

    fields: tuple[str, ...]
    id_field: str = "id"
    store_fields: tuple[str, ...] = ()
    tokenize: Callable[[Column], Column] = analysis.default_tokens
    process_term: Callable[[Column], Column] = analysis.default_terms
    extract: dict[str, Column] = field(default_factory=dict)
    null_as_empty: bool = False
    search: SearchOptions = SearchOptions()
    suggest: SearchOptions = SearchOptions()
    min_dirt_count: int = 20
    min_dirt_factor: float = 0.1
    auto_vacuum: bool = True
    running_removal: bool = False

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError('option "fields" must be provided')
        if len(set(self.fields)) < len(self.fields):
            raise ValueError("fields must not repeat")


DEFAULTS: dict[str, Any] = {
    "id_field": "id", "store_fields": (), "tokenize": analysis.default_tokens, "process_term": analysis.default_terms,
    "prefix": False, "fuzzy": False, "max_fuzzy": 6, "combine_with": CombineWith.OR, "weights": Weights(), "bm25": Bm25(),
    "min_dirt_count": 20, "min_dirt_factor": 0.1, "auto_vacuum": True, "running_removal": False, "stringify": analysis.stringify,
}


def get_default(name: str) -> Any:
    """The default of an option."""
    if name not in DEFAULTS:
        raise ValueError(f'unknown option "{name}"')
    return DEFAULTS[name]


class Wildcard:
    """Matches every document."""

    def __repr__(self) -> str:
        return "WILDCARD"


WILDCARD = Wildcard()


@dataclass(frozen=True)
class QueryNode:
    """A combination of queries; options that it sets hold for what is below it."""

    queries: tuple["str | Wildcard | QueryNode", ...]
    combine_with: CombineWith | str | None = None
    options: SearchOptions = SearchOptions()


Query = str | Wildcard | QueryNode
