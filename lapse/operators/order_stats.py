"""Exact order statistics and running values without an unbounded group in one task.

Two tools carry every ordered computation of the library:

* :func:`exact_quantiles` narrows brackets around the wanted ranks (``rank_search``); only a bounded number of
  values is ever ranked.
* :func:`slice_groups` deals groups larger than a row limit by ranges of their order, so windows run on
  (key, range) and totals per range supply the offsets. Groups below the limit stay whole and pay
  nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.operators import rank_search as R
from lapse.session import materialise

# Rows of one key that a single window task may hold.
GROUP_ROW_LIMIT = 2_000_000


# --------------------------------------------------------------------------- exact quantiles


def exact_quantiles(
    df: DataFrame, column, probabilities: Sequence[float], direct_rows: int | None = None,
    total: int | None = None,
) -> list[float | None]:
    """Linearly interpolated quantiles over the non-null values of a numeric column.

    Returns nulls for an empty column. A caller that already knows the number of non-null values passes it as ``total``.
    """
    if total == 0:
        return [None] * len(probabilities)
    values = R.series_values(df, [column])
    found = R.quantiles_of(values, probabilities, None if total is None else {0: total}, direct_rows)
    return found.get(0, [None] * len(probabilities))


def order_statistic(
    df: DataFrame, column, rank: int, direct_rows: int | None = None, total: int | None = None,
):
    """The value at a zero-based rank; ties count by row."""
    values = R.series_values(df, [column])
    totals = None if total is None else {0: total}
    return R.find_ranks(values, lambda _: {0: [rank]}, totals, direct_rows)[0][rank]


# ------------------------------------------------------------------- ordered work within keys


@dataclass(frozen=True)
class SlicedGroups:
    """A frame whose groups are cut into ordered slices (``_slice`` is 0 for whole groups)."""

    frame: DataFrame
    keys: tuple[str, ...]
    order_names: tuple[str, ...]
    descending: bool
    sliced: bool

    @property
    def slice_keys(self) -> list[str]:
        return [*self.keys, "_slice"] if self.sliced else list(self.keys)

    def _ordered(self, name: str) -> Column:
        return F.col(name).desc() if self.descending else F.col(name).asc()

    def with_frame(self, frame: DataFrame) -> SlicedGroups:
        """The same groups around a frame that gained columns."""
        return replace(self, frame=frame)

    def done(self) -> DataFrame:
        """The frame without the slice bookkeeping."""
        return self.frame.drop("_slice") if self.sliced else self.frame

    def window(self):
        """Window over one slice, in group order."""
        return Window.partitionBy(*self.slice_keys).orderBy(*map(self._ordered, self.order_names))

    def slices(self):
        """Window over the slice totals of one key, in group order; slices are numbered in it."""
        return Window.partitionBy(*self.keys).orderBy("_slice")


def slice_groups(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    tie_breakers: Sequence[str] = (),
    descending: bool = False,
    row_limit: int = GROUP_ROW_LIMIT,
    max_rows_per_key: int | None = None,
    spread_ties: Column | None = None,
) -> SlicedGroups:
    """Prepare ordered work per key without putting a hot key into one task.

    One light aggregate tells whether a key has more than ``row_limit`` rows. Where none has, windows run on the keys.
    Otherwise the rows of such keys, and only they, are dealt by ranges of (keys, order, tie-breakers): a range is a slice,
    its number follows the order, and a key goes on in the next range. That works for any number of hot keys, for texts
    and for tied order values alike; only rows that agree in all of these columns stay together.
    ``max_rows_per_key`` states a bound the caller has proven and skips the aggregate.
    ``spread_ties`` (a whole number per row) lets rows that agree fill several slices; it is for callers to whom the
    order among ties means nothing.
    """
    keys = tuple(keys)
    names = (order_by, *tie_breakers)
    whole = SlicedGroups(df, keys, names, descending, False)
    if max_rows_per_key is not None and max_rows_per_key <= row_limit:
        return whole
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > row_limit)
    hot_rows = sizes.agg(F.sum("_rows")).first()[0]
    if not hot_rows:
        return whole
    # Ranges come from a sample, so they differ in size: twice as many keep them near the limit.
    ranges = 2 * -(-int(hot_rows) // row_limit)
    order = [whole._ordered(name) for name in names]
    spread = [] if spread_ties is None else [spread_ties]
    if keys:
        marks = sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
        same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
        marked = df.join(marks, reduce(lambda a, b: a & b, same), "left").drop(*[f"_hot_{k}" for k in keys])
    else:
        marked = df.withColumn("_hot", F.lit(True))
    hot = marked.where(F.col("_hot")).drop("_hot")
    dealt = hot.repartitionByRange(ranges, *[F.col(k) for k in keys], *order, *spread)
    # Kept as they are: every reader sees the same ranges, also after a task was run again.
    frozen = materialise(dealt.withColumn("_slice", F.spark_partition_id() + 1))
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").withColumn("_slice", F.lit(0))
    return SlicedGroups(cold.unionByName(frozen), keys, names, descending, True)


def _attach(local: DataFrame, heads: DataFrame, groups: SlicedGroups) -> DataFrame:
    """Join slice facts to their rows; a null key matches itself."""
    renamed = heads.withColumnsRenamed({k: f"_head_{k}" for k in groups.slice_keys})
    same = [F.col(k).eqNullSafe(F.col(f"_head_{k}")) for k in groups.slice_keys]
    condition = same[0]
    for test in same[1:]:
        condition = condition & test
    return local.join(renamed, condition, "left").drop(*[f"_head_{k}" for k in groups.slice_keys])


def add_running_totals(
    groups: SlicedGroups, totals: Sequence[str], prefix: str = "run_"
) -> SlicedGroups:
    """Add ``run_<column>``: the inclusive running sum of each column in the group order."""
    window = groups.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = groups.frame.select(
        "*", *[F.sum(c).over(window).alias(prefix + c) for c in totals]
    )
    if not groups.sliced:
        return groups.with_frame(local)
    before = groups.slices().rowsBetween(Window.unboundedPreceding, -1)
    heads = groups.frame.groupBy(*groups.slice_keys).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in totals]
    )
    heads = heads.select(
        *groups.slice_keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in totals],
    )
    joined = _attach(local, heads, groups)
    for c in totals:
        joined = joined.withColumn(prefix + c, F.col(prefix + c) + F.col(f"_off_{c}"))
    return groups.with_frame(joined.drop(*[f"_off_{c}" for c in totals]))


def add_positions(
    groups: SlicedGroups, name: str = "position", size: str | None = None
) -> SlicedGroups:
    """Add the 1-based position of each row within its key and, on request, the key's row count."""
    local = groups.frame.withColumn(name, F.row_number().over(groups.window()).cast("long"))
    if not groups.sliced:
        if size:
            whole = Window.partitionBy(*groups.keys)
            local = local.withColumn(size, F.count(F.lit(1)).over(whole))
        return groups.with_frame(local)
    before = groups.slices().rowsBetween(Window.unboundedPreceding, -1)
    counted = groups.frame.groupBy(*groups.slice_keys).agg(F.count(F.lit(1)).alias("_n"))
    heads = counted.select(
        *groups.slice_keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*groups.keys)).alias("_all"),
    )
    joined = _attach(local, heads, groups).withColumn(name, F.col(name) + F.col("_off"))
    if size:
        joined = joined.withColumn(size, F.col("_all"))
    return groups.with_frame(joined.drop("_off", "_all"))


def add_previous(groups: SlicedGroups, value: str, name: str = "previous") -> SlicedGroups:
    """Add the value of the preceding row within the key (ascending groups only)."""
    local = groups.frame.withColumn(name, F.lag(value).over(groups.window()))
    if not groups.sliced:
        return groups.with_frame(local)
    last = F.max_by(F.col(value), F.struct(*groups.order_names))
    heads = groups.frame.groupBy(*groups.slice_keys).agg(last.alias("_last"))
    heads = heads.select(
        *groups.slice_keys, F.lag("_last").over(groups.slices()).alias("_carry")
    )
    local = local.withColumn("_head", F.row_number().over(groups.window()) == 1)
    joined = _attach(local, heads, groups)
    carried = F.when(F.col("_head"), F.col("_carry")).otherwise(F.col(name))
    return groups.with_frame(joined.withColumn(name, carried).drop("_head", "_carry"))


def running_and_group_totals(groups: SlicedGroups, totals: Sequence[str]) -> DataFrame:
    """Running totals ``run_<column>`` and, on every row, the totals of its key ``all_<column>``."""
    running = running_totals(groups, totals)
    if not groups.sliced:
        # The group sits whole in its task already, so its totals cost no further pass.
        whole = Window.partitionBy(*groups.keys)
        return running.withColumns({f"all_{c}": F.sum(c).over(whole) for c in totals})
    sums = groups.frame.groupBy(*groups.keys).agg(*[F.sum(c).alias(f"all_{c}") for c in totals])
    if groups.keys:
        return running.join(sums, list(groups.keys))
    row = sums.first()
    return running.withColumns({f"all_{c}": F.lit(row[f"all_{c}"]) for c in totals})


def running_totals(groups: SlicedGroups, totals: Sequence[str], prefix: str = "run_") -> DataFrame:
    return add_running_totals(groups, totals, prefix).done()


def positions(groups: SlicedGroups, name: str = "position", size: str | None = None) -> DataFrame:
    return add_positions(groups, name, size).done()


def previous_value(groups: SlicedGroups, value: str, name: str = "previous") -> DataFrame:
    return add_previous(groups, value, name).done()
