"""Rectangle, distance and dominance expressions over plain columns.

A point is a sequence of columns, one per dimension.  A rectangle is a pair of such sequences, the
lower and the upper corner.  Both ends are closed.  Expressions are products and comparisons of
columns, so they stay inside generated code and comparisons with literals reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def columns(values: Sequence) -> list[Column]:
    """Literals for numbers, columns as they are."""
    return [v if isinstance(v, Column) else F.lit(float(v)) for v in values]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _product(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, terms)


def contains(low: Sequence, high: Sequence, point: Point) -> Column:
    """The closed rectangle holds the point."""
    return _all([p.between(a, b) for a, b, p in zip(columns(low), columns(high), point)])


def intersects(low1: Sequence, high1: Sequence, low2: Sequence, high2: Sequence) -> Column:
    """Closed rectangles share a point; touching edges do."""
    return _all([(a1 <= b2) & (a2 <= b1) for a1, b1, a2, b2 in zip(*map(columns, (low1, high1, low2, high2)))])


def equal(p: Sequence, q: Sequence) -> Column:
    return _all([a == b for a, b in zip(columns(p), columns(q))])


def distance(p: Sequence, q: Sequence) -> Column:
    """Euclidean distance on raw coordinates."""
    return F.sqrt(_sum([(a - b) * (a - b) for a, b in zip(columns(p), columns(q))]))


def mindist(low: Sequence, high: Sequence, point: Sequence) -> Column:
    """Distance from a point to the nearest point of a rectangle (0 inside)."""
    gaps = [F.greatest(a - p, p - b, F.lit(0.0)) for a, b, p in zip(columns(low), columns(high), columns(point))]
    return F.sqrt(_sum([g * g for g in gaps]))


def maxdist(low: Sequence, high: Sequence, point: Sequence) -> Column:
    """Distance from a point to the farthest corner of a rectangle."""
    gaps = [F.greatest(F.abs(a - p), F.abs(p - b)) for a, b, p in zip(columns(low), columns(high), columns(point))]
    return F.sqrt(_sum([g * g for g in gaps]))


def dominates(p: Sequence, q: Sequence) -> Column:
    """p is nowhere larger than q and somewhere smaller (smaller is better)."""
    pairs = list(zip(columns(p), columns(q)))
    return _all([a <= b for a, b in pairs]) & reduce(lambda a, b: a | b, [a < b for a, b in pairs])


def area(low: Sequence, high: Sequence) -> Column:
    return _product([b - a for a, b in zip(columns(low), columns(high))])


def margin(low: Sequence, high: Sequence) -> Column:
    """Sum of the edge lengths."""
    return _sum([b - a for a, b in zip(columns(low), columns(high))])


def overlap(low1: Sequence, high1: Sequence, low2: Sequence, high2: Sequence) -> Column:
    """Area that two rectangles share; touching ones share 0."""
    return _product([F.greatest(F.least(b1, b2) - F.greatest(a1, a2), F.lit(0.0)) for a1, b1, a2, b2 in zip(*map(columns, (low1, high1, low2, high2)))])


def enlargement(low: Sequence, high: Sequence, low2: Sequence, high2: Sequence) -> Column:
    """Growth of the first rectangle's area when it takes in the second (a point is its own rectangle)."""
    low, high, low2, high2 = map(columns, (low, high, low2, high2))
    grown = area([F.least(a, b) for a, b in zip(low, low2)], [F.greatest(a, b) for a, b in zip(high, high2)])
    return grown - area(low, high)


def centre(low: Sequence, high: Sequence) -> list[Column]:
    return [(a + b) / 2 for a, b in zip(columns(low), columns(high))]
