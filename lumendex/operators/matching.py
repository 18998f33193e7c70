"""Query trees as boolean columns over a document's positions.

``term(t)`` and ``prefix(p)`` give the columns that hold the positions (arrays of long, null if absent) or, in queries
without positional parts, the presence (boolean) of a leaf. Every leaf is two-valued, so NOT is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import functions as F

from ..functions.analysis import FIELD_SHIFT
from ..functions.bm25 import all_of, any_of
from .query import All, And, Column, Near, Not, Or, Phrase, Prefix, Query, Term


def _sure(c: Col) -> Col:
    return F.coalesce(c, F.lit(False))


def _field(position: Col) -> Col:
    return F.shiftright(position, FIELD_SHIFT)


def _shifted(positions: Col, by: int) -> Col:
    return F.transform(positions, lambda x: x - by)


def _marked(positions: Col, number: int) -> Col:
    return F.transform(positions, lambda x: F.struct(x.alias("p"), F.lit(number).alias("k")))


def compile_query(node: Query, term: Callable[[str], Col], prefix: Callable[[str], Col], positions: bool, scope: int | None = None) -> Col:
    def inside(q: Query, scope: int | None) -> Col:
        if isinstance(q, All):
            return F.lit(True)
        if isinstance(q, And):
            return all_of([inside(c, scope) for c in q.children])
        if isinstance(q, Or):
            return any_of([inside(c, scope) for c in q.children])
        if isinstance(q, Not):
            return ~inside(q.child, scope)
        if isinstance(q, Column):
            return F.lit(False) if scope is not None and scope != q.column else inside(q.child, q.column)
        if isinstance(q, (Term, Prefix)):
            own = term(q.text) if isinstance(q, Term) else prefix(q.text)
            if not positions:
                return _sure(own)
            return _sure(F.size(own) > 0 if scope is None else F.exists(own, lambda x: _field(x) == scope))
        if isinstance(q, Phrase):
            return _phrase(q, scope)
        if isinstance(q, Near):
            return _near(q, scope)
        raise TypeError(f"no query: {q!r}")

    def _phrase(q: Phrase, scope: int | None) -> Col:
        if not q.terms:
            return F.lit(False)
        # Where all terms stand in their places, as places of the first one; linear in the lists.
        starts = term(q.terms[0])
        for i, t in enumerate(q.terms[1:], 1):
            starts = F.array_intersect(starts, _shifted(term(t), i))
        last = len(q.terms) - 1
        inside_field = lambda s: (_field(s + last) == _field(s)) & (F.lit(True) if scope is None else _field(s) == scope)
        return _sure(F.exists(starts, inside_field))

    def _near(q: Near, scope: int | None) -> Col:
        if not q.terms:
            return F.lit(False)
        # One sweep over all positions in order, with the last ones of each term: a window ends where all terms' needed ones are near enough.
        needed = list(Counter(q.terms).items())
        lists = [_marked(term(t), k) for k, (t, _) in enumerate(needed)]
        none = F.array(*[F.array_repeat(F.lit(-1).cast("bigint"), n) for _, n in needed])

        def step(seen: Col, x: Col) -> Col:
            last = F.transform(seen["last"], lambda own, k: F.when(k == x["k"], F.concat(F.slice(own, F.lit(2), F.size(own)), F.array(x["p"]))).otherwise(own))
            first = lambda own: F.get(own, F.lit(0))
            close = F.forall(last, lambda own: (first(own) >= F.greatest(x["p"] - q.distance, F.lit(0))) & (_field(first(own)) == _field(x["p"])))
            hit = close if scope is None else close & (_field(x["p"]) == scope)
            return F.struct(last.alias("last"), (seen["hit"] | hit).alias("hit"))

        every = F.array_sort(F.concat(*lists))
        return _sure(F.aggregate(every, F.struct(none.alias("last"), F.lit(False).alias("hit")), step)["hit"])

    return inside(node, scope)
