"""Seeded random splits that depend on row identity only, never on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.operators import rank_search as R
from lapse.operators.clean import category_values
from lapse.operators.order_stats import order_statistic
from lapse.schema import CUSTOMER

_KEY = "_split_key"


def _class_takes(df: DataFrame, label: str, takes) -> dict:
    """(rows to take, rows) per class, from one count per class."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {value: (min(n, max(0, takes(n, total))), n) for value, n in counts.items()}


def _class_ranks(keyed: DataFrame, label: str, ranks: dict, sizes: dict) -> dict:
    """class -> rank -> key at that zero-based rank of the class: one search for all classes."""
    wanted = {value: [r for r in some if 0 <= r < sizes[value]] for value, some in ranks.items()}
    order = [value for value, some in wanted.items() if some]
    if not order:
        return {}
    series = F.lit(None).cast("int")
    for i, value in enumerate(order):
        series = F.when(F.col(label) == F.lit(value), F.lit(i)).otherwise(series)
    values = keyed.select(series.alias("series"), F.col(_KEY).alias("v")).where("series is not null")
    found = R.find_ranks(R.known(values), lambda _: {i: wanted[v] for i, v in enumerate(order)}, {i: sizes[v] for i, v in enumerate(order)})
    return {v: found[i] for i, v in enumerate(order)}


def _under_threshold(df: DataFrame, label: str, takes: dict):
    """Condition that selects the wanted number of rows of each class, smallest keys first.

    The per-class threshold is an exact order statistic of the hash, so marking the rows is a plain
    filter instead of a ranking window over a whole class.
    """
    some = {value: [take - 1] for value, (take, size) in takes.items() if 0 < take < size}
    borders = _class_ranks(df, label, some, {value: size for value, (_, size) in takes.items()})
    condition = F.lit(False)
    for value, (take, size) in takes.items():
        if take <= 0:
            continue
        mine = F.col(label) == F.lit(value)
        if take < size:
            mine = mine & (F.col(_KEY) <= F.lit(int(borders[value][take - 1])))
        condition = condition | mine
    return condition


def half_up(x: float) -> int:
    """Rounding of positive sizes, halves away from zero, as SQL ``round`` does."""
    return int(x + 0.5)


def stratified_split(
    df: DataFrame, label: str = "lapsed", share: float = 0.3, ids: Sequence[str] = (CUSTOMER,),
    seed: int = 42, salt: str = "split",
) -> tuple[DataFrame, DataFrame]:
    """(rest, taken): ``share`` of each class goes to the second frame, at fixed class counts."""
    keyed = df.withColumn(_KEY, S.stable_hash(list(ids), seed, salt))
    takes = _class_takes(keyed, label, lambda n, _: half_up(share * n))
    taken = F.coalesce(_under_threshold(keyed, label, takes), F.lit(False))
    return keyed.where(~taken).drop(_KEY), keyed.where(taken).drop(_KEY)


def stratified_cap(
    df: DataFrame, cap: int | None, label: str = "lapsed", ids: Sequence[str] = (CUSTOMER,),
    seed: int = 42,
) -> DataFrame:
    """Class-proportional sub-sample of about ``cap`` rows, at least one per class; None keeps all."""
    if cap is None:
        return df
    keyed = df.withColumn(_KEY, S.stable_hash(list(ids), seed, "cap"))
    takes = _class_takes(
        keyed, label, lambda n, total: n if total <= cap else max(1, half_up(n * cap / total))
    )
    return keyed.where(_under_threshold(keyed, label, takes)).drop(_KEY)


def sample_rows(df: DataFrame, rows: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows with the smallest stable hashes; everything when there are fewer."""
    keyed = df.withColumn(_KEY, S.stable_hash(list(ids), seed, "sample"))
    total = keyed.count()
    if total <= rows:
        return df
    border = order_statistic(keyed, F.col(_KEY), rows - 1, total=total)
    return keyed.where(F.col(_KEY) <= F.lit(int(border))).drop(_KEY)


def with_folds(
    df: DataFrame, folds: int = 3, label: str = "lapsed", ids: Sequence[str] = (CUSTOMER,),
    seed: int = 42, name: str = "fold",
) -> DataFrame:
    """Stratified folds: within each class, hash-ordered blocks of equal size."""
    keyed = df.withColumn(_KEY, S.stable_hash(list(ids), seed, "fold"))
    counts = {r[label]: r["n"] for r in keyed.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = {value: [n * f // folds for f in range(1, folds) if n * f // folds >= 1] for value, n in counts.items() if value is not None}
    borders = _class_ranks(keyed, label, {value: [at - 1 for at in some] for value, some in starts.items()}, counts)
    fold = F.lit(0)
    for value, some in starts.items():
        for at in some:
            over = (F.col(label) == F.lit(value)) & (F.col(_KEY) > F.lit(int(borders[value][at - 1])))
            fold = fold + F.when(over, 1).otherwise(0)
    return keyed.withColumn(name, fold).drop(_KEY)


def classes(df: DataFrame, label: str = "lapsed") -> list:
    return category_values(df, label, 100)
