"""Exact percentiles of any columns by narrowing brackets around the wanted ranks.

A percentile is one or two order statistics.  Each is found by passes over the
columns, written once to the shared folder, that only count and sketch:

* a first pass counts each column's values and sketches their quantiles
  (``percentile_approx``: a buffer of fixed size, merged map-side);
* the sketch proposes a bracket (a, b) around each rank, and the next pass counts
  exactly what is below it, at its ends and inside, and sketches the inside.  The
  counts decide where the rank is, so the sketch's error costs a pass at worst,
  never the result;
* a bracket shrinks to about a six-hundredth a pass.  A sketch of ``HELD`` values or
  fewer is all of them: its error, a share of 1 / ``ACCURACY``, is under one value.

All columns and ranks share a pass, and equal brackets are counted once.  Nothing is
sorted or exploded, no buffer grows with the rows, and only counts and sketches
reach the driver.  Two passes do for half a million rows, five for a trillion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path

#: Values of a bracket that its sketch gives one by one; quantiles asked of a sketch (two a value), and its accuracy.
HELD, QUANTILES, ACCURACY = 1024, 2048, 10_000


@dataclass
class _Search:
    """One rank (from 0) of one column, known to lie strictly between ``low`` and ``high`` (None: no bound)."""

    column: int
    rank: int
    inside: int
    sketch: list | None
    low: float | None = None
    high: float | None = None
    below: int = 0      # values up to and with ``low``
    value: float | None = None

    def propose(self) -> tuple[float | None, float | None]:
        """A bracket that holds the rank unless the sketch errs; the known one if there is no sketch."""
        if self.sketch is None:
            return self.low, self.high
        at, slack = (self.rank - self.below) / self.inside, 3 / ACCURACY
        lo, hi = math.floor((at - slack) * QUANTILES), math.ceil((at + slack) * QUANTILES)
        return self.sketch[lo] if lo > 0 else self.low, self.sketch[hi] if hi < QUANTILES else self.high

    def settle(self) -> None:
        """Read the value off a sketch that holds them all."""
        if self.value is None and self.sketch is not None and self.inside <= HELD:
            self.value = self.sketch[round((self.rank - self.below + 0.5) / self.inside * QUANTILES)]

    def learn(self, low, high, under: int, at_low: int, inside: int, at_high: int, sketch) -> None:
        """What was counted for the bracket proposed: below ``low``, at it, strictly inside, at ``high``."""
        if self.rank < under:                    # the sketch erred: what is left of the known bracket
            self.high, self.inside, self.sketch = low, under - self.below, None
        elif self.rank < under + at_low:
            self.value = low
        elif self.rank < under + at_low + inside:
            self.low, self.high, self.below, self.inside, self.sketch = low, high, under + at_low, inside, sketch
        elif self.rank < under + at_low + inside + at_high:
            self.value = high
        else:
            known = under + at_low + inside + at_high
            self.low, self.inside, self.sketch = high, self.below + self.inside - known, None
            self.below = known


def _sketch(x: Column) -> Column:
    places = F.lit(",".join(str(i / QUANTILES) for i in range(QUANTILES + 1)))  # one literal, folded to an array
    return F.percentile_approx(x, F.split(places, ",").cast("array<double>"), ACCURACY)


def _inside(x: Column, low: float | None, high: float | None) -> Column:
    above = F.lit(True) if low is None else x > F.lit(low)
    return above if high is None else above & (x < F.lit(high))


def order_statistics(df: DataFrame, columns: list[Column], ranks) -> tuple[list[int], dict[tuple[int, int], float]]:
    """Counts of the columns' values, and {(column, rank): value}.

    ``ranks`` maps the counts to the (column, rank from 0) pairs wanted.  NULLs don't
    count; NaN is the greatest value, as in Spark's order.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "selection")
    try:
        df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).write.parquet(path)
        rows = spark.read.schema(", ".join(f"x{i} double" for i in range(len(columns)))).parquet(path)
        return _search(rows, [F.col(f"x{i}") for i in range(len(columns))], ranks)
    finally:
        drop_scratch(spark, path)


def _search(rows: DataFrame, xs: list[Column], ranks) -> tuple[list[int], dict[tuple[int, int], float]]:
    """The passes over the written columns."""
    number = [F.when(~F.isnan(x), x) for x in xs]
    first = rows.agg(*[a for i, x in enumerate(xs) for a in (
        F.count(x).alias(f"n{i}"), F.count_if(F.isnan(x)).alias(f"nan{i}"),
        _sketch(number[i]).alias(f"q{i}"))]).first()
    counts = [first[f"n{i}"] for i in range(len(xs))]
    found: dict[tuple[int, int], float] = {}
    todo: list[_Search] = []
    for column, rank in sorted(set(ranks(counts))):
        real = counts[column] - first[f"nan{column}"]
        if rank >= real:
            found[column, rank] = math.nan
        else:
            todo.append(_Search(column, rank, real, first[f"q{column}"]))
            todo[-1].settle()
    while True:
        found |= {(s.column, s.rank): s.value for s in todo if s.value is not None}
        todo = [s for s in todo if s.value is None]
        if not todo:
            return counts, found
        brackets: dict[tuple, list[_Search]] = {}
        for s in todo:
            brackets.setdefault((s.column, *s.propose()), []).append(s)
        aggs, none = [], F.lit(0).cast("bigint")
        for k, (column, low, high) in enumerate(brackets):
            x = number[column]
            inner = F.when(_inside(x, low, high), x)
            aggs += [none.alias(f"u{k}") if low is None else F.count_if(x < F.lit(low)).alias(f"u{k}"),
                     none.alias(f"l{k}") if low is None else F.count_if(x == F.lit(low)).alias(f"l{k}"),
                     F.count(inner).alias(f"i{k}"),
                     none.alias(f"h{k}") if high is None or low == high else F.count_if(x == F.lit(high)).alias(f"h{k}"),
                     _sketch(inner).alias(f"q{k}")]
        got = rows.agg(*aggs).first()
        for k, ((_, low, high), searches) in enumerate(brackets.items()):
            for s in searches:
                s.learn(low, high, *(got[f"{c}{k}"] for c in "ulihq"))
                s.settle()


def quantiles(df: DataFrame, specs: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Percentile ``p`` of each (expression, p), as ``percentile`` has it: position p·(n−1), linear in between."""
    columns: list[Column] = []
    index: dict[str, int] = {}
    wanted: dict[str, tuple[int, float]] = {}
    for name, (e, p) in specs.items():
        if not 0.0 <= p <= 1.0:
            raise ValueError("a percentile lies between 0 and 1")
        key = e._jc.toString() if hasattr(e, "_jc") else repr(e)
        if key not in index:
            index[key] = len(columns)
            columns.append(e)
        wanted[name] = index[key], float(p)

    def places(counts):
        for column, p in wanted.values():
            if counts[column]:
                at = (counts[column] - 1) * p
                yield column, math.floor(at)
                yield column, math.ceil(at)

    counts, found = order_statistics(df, columns, places)
    out: dict[str, float | None] = {}
    for name, (column, p) in wanted.items():
        if not counts[column]:
            out[name] = None
            continue
        at = (counts[column] - 1) * p
        lo, hi = math.floor(at), math.ceil(at)
        a, b = found[column, lo], found[column, hi]
        out[name] = a if lo == hi or a == b else (hi - at) * a + (at - lo) * b
    return out
