"""Typed queries, options and results."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..errors import InvalidInput


class Query:
    """A node of a query tree; trees are values that compare by structure."""


@dataclass(frozen=True)
class Term(Query):
    text: str


@dataclass(frozen=True)
class Prefix(Query):
    text: str


@dataclass(frozen=True)
class Phrase(Query):
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Near(Query):
    terms: tuple[str, ...]
    distance: int


@dataclass(frozen=True)
class Column(Query):
    column: int
    child: Query


@dataclass(frozen=True)
class And(Query):
    children: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    children: tuple[Query, ...]


@dataclass(frozen=True)
class Not(Query):
    child: Query


@dataclass(frozen=True)
class All(Query):
    pass


def _lower(text: str) -> str:
    # A final sigma is as the index's lower-casing has it; Python's rule for it is the same.
    return text.lower()


class query:  # noqa: N801  a namespace of constructors
    """Constructors that bring terms into the index's case. Terms aren't split."""

    @staticmethod
    def term(text: str) -> Query:
        return Term(_lower(text))

    @staticmethod
    def prefix(text: str) -> Query:
        return Prefix(_lower(text))

    @staticmethod
    def phrase(terms: Iterable[str]) -> Query:
        return Phrase(tuple(map(_lower, terms)))

    @staticmethod
    def near(terms: Iterable[str], distance: int) -> Query:
        if distance < 0:
            raise InvalidInput("a distance can't be negative")
        return Near(tuple(map(_lower, terms)), distance)

    @staticmethod
    def column(number: int, child: Query) -> Query:
        if number < 0:
            raise InvalidInput("a column can't be negative")
        return Column(min(number, 63), child)

    @staticmethod
    def and_(children: Iterable[Query]) -> Query:
        return And(tuple(children))

    @staticmethod
    def or_(children: Iterable[Query]) -> Query:
        return Or(tuple(children))

    @staticmethod
    def negate(child: Query) -> Query:
        return Not(child)

    @staticmethod
    def all_() -> Query:
        return All()


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    k1: float = 1.2
    b: float = 0.75
    cache: bool = True

    def validated(self) -> SearchOptions:
        if self.limit < 1:
            raise InvalidInput("a search must be allowed one hit at least")
        if not (math.isfinite(self.k1) and self.k1 >= 0 and math.isfinite(self.b) and 0 <= self.b <= 1):
            raise InvalidInput("k1 must be a finite number from 0 on, b one from 0 to 1")
        return self


@dataclass(frozen=True)
class SearchHit:
    rowid: int
    score: float
    fields: tuple[str, ...]


@dataclass(frozen=True)
class SearchStats:
    """candidate_docs: documents that were looked at; scored_docs: those that matched; segments: commits that were read."""

    segments: int = 0
    candidate_docs: int = 0
    scored_docs: int = 0
    cache_hit: bool = False


@dataclass(frozen=True)
class SearchResult:
    hits: list[SearchHit]
    stats: SearchStats
    generation: int
    is_approximate: bool = field(default=False)


@dataclass
class Leaves:
    """What a query needs of the index."""

    terms: set[str] = field(default_factory=set)
    prefixes: set[str] = field(default_factory=set)
    scoring_terms: set[str] = field(default_factory=set)
    scoring_prefixes: set[str] = field(default_factory=set)
    positions: bool = False


def leaves(node: Query) -> Leaves:
    """Terms and prefixes of the whole tree; those outside of any negation score."""
    out = Leaves()

    def walk(q: Query, positive: bool, scoped: bool) -> None:
        if isinstance(q, Prefix):
            out.prefixes.add(q.text)
            out.scoring_prefixes |= {q.text} if positive else set()
            out.positions |= scoped
        elif isinstance(q, (Term, Phrase, Near)):
            own = {q.text} if isinstance(q, Term) else set(q.terms)
            out.terms |= own
            out.scoring_terms |= own if positive else set()
            out.positions |= scoped or not isinstance(q, Term)
        elif isinstance(q, (And, Or)):
            for child in q.children:
                walk(child, positive, scoped)
        elif isinstance(q, Not):
            walk(q.child, False, scoped)
        elif isinstance(q, Column):
            walk(q.child, positive, True)

    walk(node, True, False)
    return out
