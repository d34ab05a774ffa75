"""Semirings as pairs of Column functions.

``mul`` combines the two values that meet in a join, ``add`` is an aggregate over
all of them for one output cell.  Both are JVM expressions, so a user semiring
runs inside generated code like the presets do.  A semiring without functions
keeps only which cells are present.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    name: str
    mul: Callable[[Column, Column], Column] | None = None
    add: Callable[[Column], Column] | None = None
    #: Type of the one that an entry of a pattern stands for.
    one: str = "bigint"

    @property
    def pattern_only(self) -> bool:
        return self.add is None


SEMIRINGS: dict[str, Semiring] = {
    s.name: s
    for s in (
        Semiring("or_and"),
        Semiring("any_pair"),
        Semiring("bool_or_and", lambda a, b: a & b, F.bool_or, "boolean"),
        Semiring("plus_times", lambda a, b: a * b, F.sum),
        Semiring("min_plus", lambda a, b: a + b, F.min),
        Semiring("max_times", lambda a, b: a * b, F.max),
    )
}


def semiring(
    name: str | Semiring,
    mul: Callable[[Column, Column], Column] | None = None,
    add: Callable[[Column], Column] | None = None,
) -> Semiring:
    """Look up a preset, or build one from user functions."""
    if isinstance(name, Semiring):
        return name
    if mul is not None or add is not None:
        if add is None:
            raise ValueError("a user semiring needs an add aggregate")
        return Semiring("user", mul or (lambda a, b: a * b), add)
    if name not in SEMIRINGS:
        raise ValueError(f"unknown semiring {name!r}; presets: {sorted(SEMIRINGS)}")
    return SEMIRINGS[name]
