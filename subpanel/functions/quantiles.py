"""Exact quantiles of unbounded columns: sketches bracket the wanted rank, exact counts settle it.

The first pass sketches every column. Where more rows than `keep` lie between the two sketch points around a
rank, the next pass counts them exactly and sketches only what lies between; otherwise the last pass counts the
few values there one by one. Three passes serve some six billion rows, each further one a several hundred times
larger table, and no pass brings more than a sketch or `keep` values per rank to the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_LARGEST = sys.float_info.max


def _finite(name: str) -> Column:
    """Missing and NaN values are ignored; infinite ones count as the largest finite number."""
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST)))


@dataclass
class _Search:
    """One rank of a column, known to lie at `low`, at `high` or between; `before` rows are not above `low`."""

    column: str
    rank: int
    before: int = 0
    inner: int = 0
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None

    def between(self) -> Column:
        return (F.col(self.column) > F.lit(self.low)) & (F.col(self.column) < F.lit(self.high))

    def narrow(self, sketch: list[float], margin: float) -> None:
        """Move both ends to the sketch points around the rank, a margin of ranks apart from it."""
        share, cells = (self.rank - self.before) / self.inner, len(sketch) - 1
        left, right = math.floor((share - margin) * cells), math.ceil((share + margin) * cells)
        # The first and last point of a sketch are the exact extremes.
        self.low, self.high = sketch[max(left, 0)], sketch[min(right, cells)]

    def settle(self, below: int, at_low: int, inner: int, at_high: int) -> None:
        """Take in exact counts of the interval."""
        if not below <= self.rank < below + at_low + inner + at_high:
            raise ArithmeticError(f"rank {self.rank} of {self.column} lies outside its bracket")
        self.before, self.inner = below + at_low, inner
        if self.rank < self.before:
            self.value = self.low
        elif self.rank >= self.before + inner:
            self.value = self.high


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]], keep: int = 10_000,
                    cells: int = 1_000, accuracy: int = 10_000) -> dict[str, float | None]:
    """Linear-interpolation quantiles as {name: value} for wanted = {name: (column, q)}; None without values.

    Every pass reads `df` anew, so it should be a stored table, not a long plan. A sketch errs by at most one
    rank in `accuracy`; the brackets leave four times that on both sides.
    """
    columns = sorted({c for c, _ in wanted.values()})
    narrow = df.select(*[_finite(c).alias(c) for c in columns])
    points = F.lit([i / cells for i in range(cells + 1)])
    margin = 4 / accuracy

    first = narrow.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(c).alias(f"n{i}"), F.percentile_approx(c, points, accuracy).alias(f"s{i}"))]).first()
    searches: dict[tuple[str, int], _Search] = {}
    for c, q in wanted.values():
        n = first[f"n{columns.index(c)}"]
        for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))} if n else ():
            searches[c, rank] = _Search(c, rank, inner=n)

    sketches = {key: first[f"s{columns.index(s.column)}"] for key, s in searches.items()}
    while wide := {k: s for k, s in searches.items() if s.value is None and s.inner > keep}:
        aggregates = []
        for i, (key, s) in enumerate(wide.items()):
            s.narrow(sketches[key], margin + 1 / s.inner)
            x = F.col(s.column)
            aggregates += [F.count_if(x < F.lit(s.low)).alias(f"b{i}"), F.count_if(x == F.lit(s.low)).alias(f"l{i}"),
                           F.count_if(s.between()).alias(f"n{i}"), F.count_if(x == F.lit(s.high)).alias(f"h{i}"),
                           F.percentile_approx(F.when(s.between(), x), points, accuracy).alias(f"s{i}")]
        row = narrow.agg(*aggregates).first()
        for i, (key, s) in enumerate(wide.items()):
            s.settle(row[f"b{i}"], row[f"l{i}"], row[f"n{i}"], row[f"h{i}"])
            sketches[key] = row[f"s{i}"]

    _count_values(narrow, [s for s in searches.values() if s.value is None])
    out: dict[str, float | None] = {}
    for name, (c, q) in wanted.items():
        n = first[f"n{columns.index(c)}"]
        position = q * (n - 1)
        low, high = (searches[c, r(position)].value if n else None for r in (math.floor, math.ceil))
        out[name] = low if low == high else low * (math.ceil(position) - position) + high * (position - math.floor(position))
    return out


def _count_values(narrow: DataFrame, searches: list[_Search]) -> None:
    """Settle ranks whose intervals hold few rows by counting each value; ranks of one interval share it."""
    spans = sorted({(s.column, s.low, s.high) for s in searches})
    if not spans:
        return
    entries = [F.when(_Search(c, 0, low=low, high=high).between(), F.struct(F.lit(i).alias("span"), F.col(c).alias("v")))
               for i, (c, low, high) in enumerate(spans)]
    counted = (narrow.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
               .groupBy("e.span", "e.v").agg(F.count(F.lit(1)).alias("n")).orderBy("span", "v").collect())
    for s in searches:
        seen, span = s.before, spans.index((s.column, s.low, s.high))
        for row in counted:
            if row["span"] == span:
                seen += row["n"]
                if seen > s.rank:
                    s.value = row["v"]
                    break
