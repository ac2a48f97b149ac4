"""Exact quantiles (linear interpolation) that do not need all values of a column in one place."""
from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.skew import written
from plumbline.functions.text import ident, missing_nan

DIRECT_VALUES = 1_000_000     # up to this many distinct values the built-in percentile holds them in one task
_ACCURACY = 10_000
_AT_ONCE = 4                  # columns whose jobs run side by side


@dataclass
class _Search:
    """A wanted order statistic, and the open range (lo, hi) it lies in until its value is known."""
    column: str
    rank: int                # 0-based
    below: int               # values at or under lo
    inside: int              # values in the range
    lo: float | None = None  # None: no bound
    hi: float | None = None
    value: float | None = None

    def narrow(self, points: list[float], counts: list[int]) -> None:
        """``points``: ascending values of the range; ``counts``: how many values lie under, at, ... , and above them (one more gap than points)."""
        under, before = self.below, self.lo
        for i, point in enumerate(points):
            under += counts[2 * i]
            if self.rank < under:
                self.lo, self.hi, self.below, self.inside = before, point, under - counts[2 * i], counts[2 * i]
                return
            if self.rank < under + counts[2 * i + 1]:
                self.value = point
                return
            under, before = under + counts[2 * i + 1], point
        self.lo, self.below, self.inside = before, under, counts[-1]


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], direct_values: int = DIRECT_VALUES,
                    counted: dict[str, DataFrame] | None = None) -> dict[str, list[float] | None]:
    """Column -> its quantiles, or None when it has no values. NaN and NULL are missing.

    A column's values are counted and stored once (``counted`` has what is there already: column -> stored (value, n)), everything after reads
    values and counts. Few distinct values: one aggregate. Many: every wanted rank is searched for, all ranks of a column at once and
    columns side by side. A round takes values around each rank and at the quarters of its open range from a sketch of the
    distinct values and sums the counts under and at them. The rank is at one of them or in the open range between two neighbours, which has at
    most about a quarter of the distinct values whatever their counts, and about 1/2500 where counts do not depend on values. Later rounds read only
    the values of open ranges. No values are sorted, collected or sent to one task.
    """
    if not columns:
        return {}

    def values_of(c: str) -> DataFrame:
        number = F.expr(missing_nan(ident(c))).alias("v")
        if counted and c in counted:
            n = next(x for x in counted[c].columns if x != c)
            return counted[c].select(number, F.col(ident(n)).alias("n")).where("v IS NOT NULL")
        return written(df.select(number).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "values")

    def head_of(c: str) -> tuple[DataFrame, int, int]:
        rows = values_of(c)
        return rows, *rows.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("v")).first()

    def direct_of(c: str) -> list[float]:
        wanted = ", ".join(f"{p!r}D" for p in shares)
        return list(heads[c][0].selectExpr(f"percentile(v, array({wanted}), n)").first()[0])

    def searched(c: str) -> list[float]:
        rows, size, _ = heads[c]
        places = [p * (size - 1) for p in shares]
        searches = {rank: _Search(c, rank, 0, size) for at in places for rank in (math.floor(at), math.ceil(at))}
        # stored, the value is a plain column; computed, its expression would be copied into every comparison
        rows = written(rows, "values") if counted and c in counted else rows
        whole = True
        while wide := [s for s in searches.values() if s.value is None]:
            if not whole:
                rows = written(rows.where(_open(wide)), "open")
            _round(rows, wide)
            whole = False
        found = []
        for at in places:
            low, high = searches[math.floor(at)].value, searches[math.ceil(at)].value
            found.append(low if low == high else low + (at - math.floor(at)) * (high - low))
        return found

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        heads = dict(zip(columns, pool.map(head_of, columns)))
        out: dict[str, list[float] | None] = {c: None for c in columns if not heads[c][1]}
        todo = [c for c in columns if heads[c][1]]
        direct, held = [], 0
        for c in sorted(todo, key=lambda c: heads[c][2]):
            if held + heads[c][2] <= direct_values:
                direct.append(c)
                held += heads[c][2]
        out.update(zip(todo, pool.map(lambda c: direct_of(c) if c in direct else searched(c), todo)))
    return out


def _round(rows: DataFrame, wide: list[_Search]) -> None:
    """Two scans of one column's (v, n): sketches of the ranges that are still open, then counts at the values that they name."""
    shared: dict[tuple[float | None, float | None], list[_Search]] = {}
    for s in wide:                                 # ranks in the same range share one sketch
        shared.setdefault((s.lo, s.hi), []).append(s)
    c = F.col("v")
    sketches: list[Column] = []
    for (lo, hi), group in shared.items():
        asked = {0.25, 0.5, 0.75}
        for s in group:
            near, far = 2.0 / _ACCURACY, 2.0 / _ACCURACY + 2.0 / math.sqrt(s.inside)
            first, last = (s.rank - s.below) / s.inside, (s.rank + 1 - s.below) / s.inside
            asked |= {min(1.0, max(0.0, x)) for x in (first - far, first - near, last + near, last + far)}
        sketches.append(F.percentile_approx(F.when(_inside(c, lo, hi), c), sorted(asked), _ACCURACY))
    named = [sorted(set(sketch)) for sketch in rows.select(*sketches).first()]
    points = sorted({v for sketch in named for v in sketch} | {x for key in shared for x in key if x is not None})
    place = {v: i for i, v in enumerate(points)}
    found = {r["k"]: r["n"] for r in rows.groupBy(_bucket(c, points, 0, len(points)).alias("k")).agg(F.sum("n").alias("n")).collect()}
    for ((lo, hi), group), own in zip(shared.items(), named):
        first = 0 if lo is None else 2 * place[lo] + 2
        last = 2 * len(points) if hi is None else 2 * place[hi]
        inner = [i for i in range(first, last + 1) if i % 2 and points[i // 2] in set(own)]
        ends = [first - 1, *inner, last + 1]
        counts = []
        for a, b in zip(ends, ends[1:]):           # the gap before each point, then the point
            counts += [sum(found.get(k, 0) for k in range(a + 1, b)), found.get(b, 0)]
        for s in group:
            s.narrow([points[i // 2] for i in inner], counts[:-1])


def _open(wide: list[_Search]) -> Column:
    """TRUE for a value in one of the ranges."""
    ends = sorted({x for s in wide for x in (s.lo, s.hi) if x is not None})
    spans = [(0 if s.lo is None else 2 * ends.index(s.lo) + 2, 2 * len(ends) if s.hi is None else 2 * ends.index(s.hi)) for s in wide]
    return _bucket(F.col("v"), ends, 0, len(ends)).isin(sorted({k for first, last in spans for k in range(first, last + 1)}))


def _inside(c: Column, lo: float | None, hi: float | None) -> Column:
    test = F.lit(True) if lo is None else c > F.lit(lo)
    return test if hi is None else test & (c < F.lit(hi))


def _bucket(c: Column, points: list[float], first: int, end: int) -> Column:
    """2 i + 1 at points[i], 2 i between points[i - 1] and points[i]: a search by halves, so a row meets few of the points."""
    if first == end:
        return F.lit(2 * first)
    mid = (first + end) // 2
    return (F.when(c < F.lit(points[mid]), _bucket(c, points, first, mid))
            .when(c > F.lit(points[mid]), _bucket(c, points, mid + 1, end)).otherwise(F.lit(2 * mid + 1)))
