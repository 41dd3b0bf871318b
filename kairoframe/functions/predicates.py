"""Interval and containment predicates as column expressions; intervals are closed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def starts_before_end(t_start="t_start", q_end="q_end") -> Column:
    return _c(t_start) <= _c(q_end)


def ends_after_start(t_end="t_end", q_start="q_start") -> Column:
    return _c(q_start) <= _c(t_end)


def overlaps(t_start="t_start", t_end="t_end", q_start="q_start", q_end="q_end") -> Column:
    return starts_before_end(t_start, q_end) & ends_after_start(t_end, q_start)


def contains_all(elements="elements", elems="elems") -> Column:
    return F.size(F.array_except(_c(elems), _c(elements))) == 0


def contains_from(offset: int, elements="elements", elems="elems") -> Column:
    """Containment of the elements from a place on, for those before were checked."""
    rest = F.slice(_c(elems), offset + 1, F.greatest(F.size(_c(elems)) - offset, F.lit(0)))
    return F.forall(rest, lambda x: F.array_contains(_c(elements), x))


def clip(t_start: Column, t_end: Column, lo, hi) -> tuple[Column, Column]:
    """The part of an interval inside lo..hi, in absolute time."""
    return F.greatest(t_start, F.lit(lo)), F.least(t_end, F.lit(hi))


def element_bound(rel: float, dict_size: int) -> int:
    """A relative bound on the log scale of element ids; 0 stays 0."""
    return 0 if rel <= 0 else min(dict_size, math.ceil(round(10 ** (rel * math.log10(max(dict_size, 1))), 9)))


def time_bound(rel: float, lo: int, hi: int) -> int:
    """A relative bound on the linear scale of time."""
    return lo + math.ceil(rel * (hi - lo))
