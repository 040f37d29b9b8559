"""Exact order statistics of many series in one search.

A series is a column, a group of rows, or both; a search takes all wanted ranks of all series at once. Every rank has a
bracket of two values around it. One aggregate a round sketches the values within all brackets and tallies the rows under
and at their ends, which narrows each bracket to a few cells of its sketch; when all brackets are narrow, one more job
counts the values that are left and picks the ranks. Series of few rows need no sketch. So a search takes two jobs up to
some hundred million rows and four for a thousand times as many, however many columns, groups and ranks it is for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells of a sketch, and its accuracy: a cell has at most n / CELLS + 2 n / ACCURACY rows besides those tied with its ends.
CELLS, ACCURACY = 2_048, 20_000
# Different values that may come to the driver in the last job, of all brackets together.
DIRECT_VALUES = 500_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass
class _Bracket:
    """A wanted rank of a series. ``low`` and ``high`` are None while nothing is known; ``inside`` is the most rows that can
    lie strictly between them."""

    series: int
    rank: int
    low: object = None
    high: object = None
    inside: float = 0.0
    found: object = None


def series_values(df: DataFrame, columns: Sequence[Column | str], where: Sequence[Column] | None = None) -> DataFrame:
    """(series, v): one row per row and column, without nulls and NaN; series are numbered as the columns.

    Whole numbers stay whole, all else but a single column becomes double. ``where`` limits the rows of each.
    """
    picked = [F.col(c) if isinstance(c, str) else c for c in columns]
    if where is not None:
        picked = [F.when(test, c) for c, test in zip(picked, where)]
    kinds = [kind for _, kind in df.select(*[c.alias(f"c{i}") for i, c in enumerate(picked)]).dtypes]
    if len(picked) == 1:
        values = df.select(F.lit(0).alias("series"), picked[0].alias("v"))
    else:
        kind = "bigint" if all(k in _WHOLE for k in kinds) else "double"
        each = F.array(*[F.struct(F.lit(i).alias("series"), c.cast(kind).alias("v")) for i, c in enumerate(picked)])
        values = df.select(F.explode(each).alias("s")).select("s.series", "s.v")
    return known(values)


def known(values: DataFrame) -> DataFrame:
    values = values.where(F.col("v").isNotNull())
    return values.where(~F.isnan("v")) if dict(values.dtypes)["v"] in ("double", "float") else values


def _sketch() -> Column:
    return F.percentile_approx("v", [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("cells")


def _within(values: DataFrame, open_: list[_Bracket]) -> DataFrame:
    """``values`` joined to the brackets of their series: a table of one row per wanted rank."""
    kind = dict(values.dtypes)["v"]
    rows = [(i, b.series, b.low, b.high) for i, b in enumerate(open_)]
    table = values.sparkSession.createDataFrame(rows, f"target int, of int, low {kind}, high {kind}")
    return values.join(F.broadcast(table), F.col("series") == F.col("of"))


def _narrow(b: _Bracket, cells: list, n: int, rank: int) -> None:
    """To the cells around ``rank`` of ``n`` sketched rows, two on either side for the sketch's error."""
    at = int(rank / max(1, n - 1) * CELLS)
    b.low, b.high = cells[max(0, at - 2)], cells[min(CELLS, at + 3)]
    if isinstance(b.low, int):
        # A sketch holds doubles, which round large whole numbers.
        b.low, b.high = b.low - (abs(b.low) >> 52) - 1, b.high + (abs(b.high) >> 52) + 1
    b.inside = n * (5 / CELLS + 4 / ACCURACY)


def find_ranks(
    values: DataFrame, wanted: Callable[[Mapping[int, int]], Mapping[int, Sequence[int]]], totals: Mapping[int, int] | None = None,
    direct: int | None = None,
) -> dict[int, dict[int, object]]:
    """series -> zero-based rank -> value, for the ranks that ``wanted`` names when it is told the rows of every series.

    ``values`` holds (series, v) without nulls. Series without rows are missing in what ``wanted`` is told. ``totals``
    saves a job where few rows are known beforehand.
    """
    direct = DIRECT_VALUES if direct is None else direct
    few = totals is not None and sum(totals.values()) <= direct
    counts, cells = ({s: n for s, n in totals.items() if n}, {}) if few else ({}, {})
    if not few:
        for row in values.groupBy("series").agg(F.count("*").alias("n"), _sketch()).collect():
            counts[row["series"]], cells[row["series"]] = row["n"], row["cells"]
    every = [_Bracket(s, r) for s, ranks in wanted(counts).items() for r in dict.fromkeys(ranks)]
    small = sum(counts.values()) <= direct
    for b in every:
        if not small:
            _narrow(b, cells[b.series], counts[b.series], b.rank)
    while wide := [b for b in every if b.found is None and b.inside > max(1, direct // len(every))]:
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        strictly = (v > low) & (v < high)
        found = _within(values, wide).groupBy("target").agg(
            F.count(F.when(v < low, 1)).alias("under"), F.count(F.when(v == low, 1)).alias("at_low"),
            F.count(F.when(strictly, 1)).alias("mid"), F.count(F.when((v == high) & (high > low), 1)).alias("at_high"),
            F.percentile_approx(F.when(strictly, v), [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("cells")).collect()
        for row in found:
            b = wide[row["target"]]
            first = row["under"] + row["at_low"]
            if row["under"] <= b.rank < first:
                b.found = b.low
            elif first <= b.rank < first + row["mid"]:
                _narrow(b, row["cells"], row["mid"], b.rank - first)
            elif first + row["mid"] <= b.rank < first + row["mid"] + row["at_high"]:
                b.found = b.high
            else:
                raise AssertionError("a sketch missed its rank by more than its accuracy")
    left = [b for b in every if b.found is None]
    if left:
        # Rows under a bracket are counted as one value, null; small series have no bracket and all their values count.
        v = F.col("v")
        rows = values.where(F.col("series").isin(sorted({b.series for b in left})))
        if small:
            counted = rows.groupBy("series", "v").agg(F.count("*").alias("n")).collect()
            tables: dict = {}
            for row in counted:
                tables.setdefault(row["series"], []).append((row["v"], row["n"]))
            listed = [tables[b.series] for b in left]
        else:
            inside = _within(rows, left).where(v <= F.col("high"))
            counted = inside.groupBy("target", F.when(v >= F.col("low"), v).alias("v")).agg(F.count("*").alias("n")).collect()
            listed = [[] for _ in left]
            for row in counted:
                listed[row["target"]].append((row["v"], row["n"]))
        ordered: dict[int, list] = {}
        for b, table in zip(left, listed):
            pairs = ordered.get(id(table)) or ordered.setdefault(id(table), sorted(table, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)))
            upto = 0
            for value, n in pairs:
                upto += n
                if b.rank < upto:
                    b.found = value
                    break
    out: dict[int, dict[int, object]] = {}
    for b in every:
        out.setdefault(b.series, {})[b.rank] = b.found
    return out


def interpolated(low, high, fraction: float) -> float:
    """Weighted mean of two neighbours, rounded as DuckDB's quantile_cont does (one fused step): instants in microseconds are so
    large that another order of the same sum ends on another microsecond."""
    low, high = float(low), float(high)
    return math.fma(low, 1.0 - fraction, high * fraction) if fraction else low


def quantiles_of(
    values: DataFrame, probabilities: Sequence[float], totals: Mapping[int, int] | None = None, direct: int | None = None,
) -> dict[int, list[float]]:
    """series -> linearly interpolated quantiles; series without values are missing."""
    def ranks(n: int) -> list[tuple[int, int, float]]:
        positions = [p * (n - 1) for p in probabilities]
        return [(int(x), min(int(x) + 1, n - 1), x - int(x)) for x in positions]

    sizes: dict[int, int] = {}

    def wanted(counts: Mapping[int, int]) -> dict[int, list[int]]:
        sizes.update(counts)
        return {s: [r for low, high, _ in ranks(n) for r in (low, high)] for s, n in counts.items()}

    found = find_ranks(values, wanted, totals, direct)
    return {s: [interpolated(found[s][low], found[s][high], part) for low, high, part in ranks(n)] for s, n in sizes.items()}


def column_quantiles(
    df: DataFrame, columns: Sequence[Column | str], probabilities: Sequence[float], direct: int | None = None,
) -> list[list[float | None]]:
    """Quantiles of each column over its values that are neither null nor NaN; nulls for a column without any."""
    found = quantiles_of(series_values(df, columns), probabilities, direct=direct)
    return [found.get(i, [None] * len(probabilities)) for i in range(len(columns))]
