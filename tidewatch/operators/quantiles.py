"""Exact quantiles without holding a column's distinct values in one task."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stage

#: Up to this many values in all columns together, Spark's own exact ``percentile`` holds them in one job.
SMALL = 2_000_000
#: A bracket with no more rows than this is counted value by value.
_COUNTED = 100_000
_ACCURACY = 10_000


@dataclass(frozen=True)
class _Bracket:
    """The values of one column strictly between two bounds, and the wanted ranks among them."""

    column: str
    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: tuple[int, ...]

    @property
    def value(self) -> Column:
        """The column's value inside the bracket, else NULL."""
        x, held = F.col(self.column), F.col(self.column).isNotNull()
        held = held if self.low is None else held & (x > F.lit(self.low))
        held = held if self.high is None else held & (x < F.lit(self.high))
        return F.when(held, x)


def _narrowed(values: DataFrame, brackets: list[_Bracket]) -> tuple[dict[tuple[str, int], float], list[_Bracket]]:
    """One round for all brackets: answers found, and the smaller brackets that hold the other ranks.

    The first job takes an approximate percentile on either side of each bracket's ranks, the second
    counts the rows under, on and between the two values. A round leaves a small share of the rows, and
    at least one value less, however many rows are equal.
    """
    margin = 2.0 / _ACCURACY
    cuts = values.agg(*[
        F.percentile_approx(b.value, [
            max(0.0, (b.ranks[0] - b.below) / b.inside - margin), min(1.0, (b.ranks[-1] + 1 - b.below) / b.inside + margin),
        ], _ACCURACY).alias(f"b{i}") for i, b in enumerate(brackets)
    ]).first()
    counts = values.agg(*[
        F.count_if(test).alias(f"{name}{i}")
        for i, b in enumerate(brackets)
        for x, (lo, hi) in [(b.value, cuts[f"b{i}"])]
        for name, test in (("under", x < lo), ("low", x == lo), ("between", (x > lo) & (x < hi)), ("upto", x <= hi))
    ]).first()
    found: dict[tuple[str, int], float] = {}
    left: list[_Bracket] = []
    for i, b in enumerate(brackets):
        lo, hi = cuts[f"b{i}"]
        under = b.below + counts[f"under{i}"]
        middle = under + counts[f"low{i}"]
        upper = middle + counts[f"between{i}"]
        last = b.below + counts[f"upto{i}"]
        found.update({(b.column, r): lo for r in b.ranks if under <= r < middle})
        found.update({(b.column, r): hi for r in b.ranks if upper <= r < last})
        parts = ((b.low, lo, b.below, under), (lo, hi, middle, upper), (hi, b.high, last, b.below + b.inside))
        for low, high, start, end in parts:
            ranks = tuple(r for r in b.ranks if start <= r < end)
            if ranks:
                left.append(_Bracket(b.column, low, high, start, end - start, ranks))
    return found, left


def _counted(values: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Values at the ranks of small brackets: one job, one row per rank to the driver."""
    inside = F.filter(
        F.array(*[F.struct(F.lit(i).alias("b"), b.value.alias("x")) for i, b in enumerate(brackets)]), lambda s: s["x"].isNotNull()
    )
    counts = values.select(F.inline(inside)).groupBy("b", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.create_map(*[
        x for i, b in enumerate(brackets) for x in (F.lit(i), F.array(*[F.lit(r - b.below) for r in b.ranks]))
    ])
    held = F.filter(F.element_at(wanted, F.col("b")), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    rows = counts.withColumn("upto", upto).select("b", "x", F.explode(held).alias("r")).collect()
    return {(brackets[r["b"]].column, r["r"] + brackets[r["b"]].below): r["x"] for r in rows}


def _values_at(values: DataFrame, sizes: dict[str, int], ranks: dict[str, list[int]], limit: int) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of several columns, all narrowed in the same passes.

    The number of jobs is that of the rounds (three or so at any size), not of the columns or ranks. Every
    bracket ends at no more than ``limit`` rows, so no task holds a column's distinct values.
    """
    found: dict[tuple[str, int], float] = {}
    wide = [_Bracket(c, None, None, 0, sizes[c], tuple(sorted(set(rs)))) for c, rs in ranks.items()]
    small: list[_Bracket] = []
    while wide or small:
        small += [b for b in wide if b.inside <= limit]
        wide = [b for b in wide if b.inside > limit]
        if not wide:
            return found | _counted(values, small)
        answers, wide = _narrowed(values, wide)
        found |= answers
    return found


def _lerp(a: float, b: float, t: float) -> float:
    return a if a == b else a + (b - a) * t


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], small: int = SMALL) -> dict[str, float | None]:
    """Linear-interpolated quantiles (NULL and NaN skipped) as plain numbers.

    Up to ``small`` values in all, Spark's own exact ``percentile`` is used in one job; beyond that
    the brackets of all quantiles are narrowed together.
    """
    clean = {
        name: F.nanvl(c.cast("double"), F.lit(None).cast("double")) for name, (c, _) in wanted.items()
    }
    narrow = df.select(*[c.alias(name) for name, c in clean.items()])
    sizes = narrow.agg(*[F.count(name).alias(name) for name in clean]).first().asDict()
    out: dict[str, float | None] = {name: None for name in wanted}
    solid = [name for name in wanted if sizes[name]]
    if sum(sizes.values()) <= small:
        if solid:
            row = narrow.agg(*[F.percentile(name, F.lit(wanted[name][1])).alias(name) for name in solid]).first()
            out.update(row.asDict())
        return out
    position = {name: wanted[name][1] * (sizes[name] - 1) for name in solid}
    ranks = {name: [floor(p), ceil(p)] for name, p in position.items()}
    found = _values_at(narrow, sizes, ranks, min(small, _COUNTED))
    for name, (lo, hi) in ranks.items():
        out[name] = _lerp(found[name, lo], found[name, hi], position[name] - lo)
    return out


def quantiles_once(df: DataFrame, wanted: dict[str, tuple[Column, float]], small: int = SMALL) -> dict[str, float | None]:
    """``exact_quantiles`` of a computed table: only the asked-for values are written and then
    read several times, so its plan runs once and with no other column."""
    narrow = stage(df.select(*[c.alias(n) for n, (c, _) in wanted.items()]), "quantiles")
    return exact_quantiles(narrow, {n: (F.col(n), q) for n, (_, q) in wanted.items()}, small)


def bounds(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float | None, float | None]]:
    """(min, max) of each expression, in one pass."""
    aggs = [f(c).alias(f"{p}{n}") for n, c in columns.items() for p, f in (("lo_", F.min), ("hi_", F.max))]
    row = df.agg(*aggs).first()
    return {n: (row[f"lo_{n}"], row[f"hi_{n}"]) for n in columns}
