"""Small text helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze_ends(text: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's trim strips blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def remove_all(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), phrases, text)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def contains_all(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words])


def fill(template: str, **slots: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template; slot values are never re-read."""
    pieces: list[Column] = []
    rest = template
    for name, value in slots.items():
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), value]
    return F.concat(*pieces, F.lit(rest))


def label_of_kind(kind: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(
        lambda other, p: F.when(kind == p[0], F.lit(p[1])).otherwise(other),
        reversed(pairs),
        F.lit(None).cast("string"),
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``.

    Written as a one-element transform: the expression stays linear in the number
    of steps, also when a filter on its result is pushed below the projection.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
