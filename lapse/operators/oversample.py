"""Minority oversampling by interpolation between neighbours, seeded by row identity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.operators import order_stats as O
from lapse.operators.features import feature_columns
from lapse.operators.labels import LABEL
from lapse.schema import CUSTOMER
from lapse.session import materialise

SYNTHETIC = "synthetic"
# Vectors of one cell; a task compares the vectors of one cell with those of one cell.
CELL_ROWS = 8_192
# Vectors that the tree of boxes is made from.
TREE_ROWS = 100_000
_BLOCK = 512
_NEAR = "array<struct<gap: double, x: array<double>>>"


def squared_gaps(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature: the same bits whatever rows are compared together."""
    gaps = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        gaps += (queries[:, j, None] - points[None, :, j]) ** 2
    return gaps


def nearest(
    queries: np.ndarray, points: np.ndarray, copies: np.ndarray, k: int, own: bool,
) -> list[list[tuple[float, list[float]]]]:
    """Per query its k nearest points as (squared distance, vector), by distance and then vector.

    A point that stands for several rows is listed as often. With ``own`` the queries are the points,
    and one row of each point is the query itself. Works in blocks, so memory is linear in the rows.
    """
    order = np.lexsort(points.T[::-1])
    points, copies = points[order], copies[order]
    place = np.empty(len(order), dtype=int)
    place[order] = np.arange(len(order))
    out = []
    for start in range(0, len(queries), _BLOCK):
        rows = squared_gaps(queries[start : start + _BLOCK], points)
        for i, gaps in enumerate(rows):
            left = copies
            if own:
                left = copies.copy()
                left[place[start + i]] -= 1
            # At most k points and the emptied own one matter; ties with the last stay in.
            wanted = min(k + 1, len(gaps))
            border = np.partition(gaps, wanted - 1)[wanted - 1]
            close = np.flatnonzero(gaps <= border)
            close = close[np.argsort(gaps[close], kind="stable")]
            found: list[tuple[float, list[float]]] = []
            for c in close:
                found += [(float(gaps[c]), points[c].tolist())] * min(int(left[c]), k - len(found))
                if len(found) == k:
                    break
            out.append(found)
    return out


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


@dataclass(frozen=True)
class BoxTree:
    """Splits of the space into boxes: a vector at or under a node's threshold goes left; ``cell`` numbers the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, rows: float, cell_rows: int) -> BoxTree:
        """Halves along the feature of the largest spread, until a box has about ``cell_rows`` of ``rows`` vectors."""
        feature, threshold, left, right, cell = [-1], [0.0], [-1], [-1], [-1]
        share, cells = rows / max(1, len(sample)), 0
        stack = [(0, np.arange(len(sample)))]
        while stack:
            node, held = stack.pop()
            x = sample[held]
            spread = x.max(axis=0) - x.min(axis=0) if len(held) else np.zeros(sample.shape[1])
            j = int(spread.argmax()) if len(spread) else 0
            if len(held) * share <= cell_rows or not len(spread) or spread[j] == 0:
                cell[node], cells = cells, cells + 1
                continue
            # The middle value, or the one before the largest: both sides have some.
            values = np.sort(x[:, j])
            t = values[(len(values) - 1) // 2]
            if t == values[-1]:
                t = values[np.searchsorted(values, t, side="left") - 1]
            feature[node], threshold[node] = j, t
            for side, part in ((left, held[x[:, j] <= t]), (right, held[x[:, j] > t])):
                side[node] = len(feature)
                stack.append((len(feature), part))
                for column, empty in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (cell, -1)):
                    column.append(empty)
        return cls(*map(np.array, (feature, threshold, left, right, cell)))

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.left[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            inner = inner[self.left[at[inner]] >= 0]
        return self.cell[at]


def with_cells(vectors: DataFrame, features: Sequence[str], size: int, cell_rows: int) -> DataFrame:
    """Add ``_cell``: boxes of about ``cell_rows`` vectors, by a tree over all features.

    The tree is made from the ``TREE_ROWS`` vectors with the smallest hash, a bounded sample. Cells only decide which task
    compares what; every neighbour search is exact (:func:`neighbours`).
    """
    if size <= cell_rows:
        return vectors.withColumn("_cell", F.lit(0).cast("long"))
    sample = vectors.orderBy(F.xxhash64("_x"), "_x").limit(TREE_ROWS).select("_x").toArrow().column("_x").combine_chunks()
    tree = BoxTree.of(sample.flatten().to_numpy().reshape(-1, len(features)), size, cell_rows)

    @F.arrow_udf("long")
    def place(column: pa.Array) -> pa.Array:
        return pa.array(tree.cells_of(column.flatten().to_numpy().reshape(len(column), -1)))

    return vectors.withColumn("_cell", place("_x"))


def _asked(state: DataFrame, low: np.ndarray, high: np.ndarray, cells: np.ndarray, k: int) -> DataFrame:
    """(_x, _cell, _to) of the other cells whose box is not farther than the worst of a vector's neighbours so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            own = batch.column(1).to_numpy()
            worst = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            worst = np.where(np.isnan(worst), np.inf, worst)
            rows, to = [], []
            for start in range(0, len(x), _BLOCK):
                part = x[start:start + _BLOCK]
                gap = np.zeros((len(part), len(cells)))
                for j in range(part.shape[1]):  # summed as distances are, so that rounding rules out no neighbour
                    outside = np.maximum(np.maximum(low[None, :, j] - part[:, j, None], part[:, j, None] - high[None, :, j]), 0.0)
                    gap += outside ** 2
                row, box = np.nonzero((gap <= worst[start:start + _BLOCK, None]) & (cells[None] != own[start:start + _BLOCK, None]))
                rows.append(row + start)
                to.append(cells[box])
            picked = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(np.concatenate(to) if to else [], pa.int64())],
                ["_x", "_cell", "_to"])

    worst = F.when(F.size("_near") >= k, F.element_at("_near", -1)["gap"])
    return state.select("_x", "_cell", worst.alias("worst")).mapInArrow(run, "_x array<double>, _cell long, _to long")


def _searched(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """``_x``, ``_found``: the k nearest points of the cell a query is sent to.

    One task holds the queries of one cell and the points of one cell, both at most a cell large.
    """

    def search(asked, held):
        import pandas as pd

        if asked.empty or held.empty:
            return pd.DataFrame({"_x": [], "_found": []})
        near = nearest(
            np.vstack(asked["_x"].to_numpy()).astype(float), np.vstack(held["_p"].to_numpy()).astype(float),
            held["_n"].to_numpy(), k, bool(asked["_off"].iloc[0] == 0))
        found = [[{"gap": gap, "x": x} for gap, x in row] for row in near]
        return pd.DataFrame({"_x": asked["_x"].to_list(), "_found": found})

    schema = f"_x array<double>, _found {_NEAR}"
    pairs = queries.select("_to", "_off").distinct()
    sent = points.select(F.col("_cell").alias("_to"), F.col("_x").alias("_p"), "_n").join(pairs, "_to").select(
        F.col("_to").alias("_at"), F.col("_off").alias("_by"), "_p", "_n")
    return (queries.select("_to", "_off", "_x").groupBy("_to", "_off")
            .cogroup(sent.groupBy("_at", "_by")).applyInPandas(search, schema))


def neighbours(
    minority: DataFrame, features: Sequence[str], k: int = 5, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``_x``, ``_n`` (rows with that vector), ``_near``: the k nearest other rows of each distinct vector.

    Exact at every size and the same for every ``cell_rows``: ordered by squared distance, then vector;
    equal rows are neighbours at distance zero. A vector first meets its own box of the tree, which bounds the distance of
    its neighbours, and then all boxes that are not farther than that. No row with a null feature may come in.
    """
    point = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    vectors = materialise(minority.groupBy(point.alias("_x")).agg(F.count(F.lit(1)).alias("_n")))
    size = vectors.count()
    celled = with_cells(vectors, features, size, cell_rows)
    celled = materialise(celled) if size > cell_rows else celled
    own = celled.select(F.col("_cell").alias("_to"), F.lit(0).cast("long").alias("_off"), "_x")
    state = celled.join(_searched(own, celled, k), "_x").withColumnRenamed("_found", "_near")
    if size > cell_rows:
        state = materialise(state)
        each = range(len(features))
        boxes = celled.groupBy("_cell").agg(
            F.array(*[F.min(F.col("_x")[i]) for i in each]).alias("low"), F.array(*[F.max(F.col("_x")[i]) for i in each]).alias("high")).collect()
        low, high = (np.array([r[c] for r in boxes], float) for c in ("low", "high"))
        asked = _asked(state, low, high, np.array([r["_cell"] for r in boxes], np.int64), k)
        # One task holds the queries of one cell and the points of one other.
        asked = materialise(asked.select("_x", "_to", (F.col("_cell") + 1).alias("_off")))
        more = _searched(asked, celled, k).groupBy("_x").agg(F.flatten(F.collect_list("_found")).alias("_more"))
        joined = F.concat("_near", F.coalesce("_more", F.array().cast(_NEAR)))
        state = state.join(more, "_x", "left").withColumn("_near", F.slice(F.array_sort(joined), 1, k)).drop("_more")
    return state.select("_x", "_n", "_near")


def oversample(
    train: DataFrame, label: str = LABEL, ids: Sequence[str] = (CUSTOMER,), k: int = 5,
    seed: int = 42, features: Sequence[str] | None = None, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Training rows plus synthetic minority rows until both classes are equal.

    Adds ``synthetic``. Each minority row is the base of equally many synthetic rows, up to one;
    base, neighbour and position between them come from stable hashes, so the result depends neither
    on partitioning nor on retries.
    """
    names = list(features or feature_columns(train))
    base = train.withColumn(SYNTHETIC, F.lit(False))
    counts = class_counts(train, label)
    if len(counts) < 2:
        return base
    small = min(counts, key=lambda v: (counts[v], v))
    m, gap = counts[small], max(counts.values()) - counts[small]
    if gap == 0 or m == 0:
        return base

    key = "_base_key"
    minority = train.where(F.col(label) == F.lit(small)).withColumn(
        key, S.stable_hash(list(ids), seed, "smote")
    )
    extra = F.lit(0)
    if gap % m:
        border = int(O.order_statistic(minority, F.col(key), gap % m - 1))
        extra = F.when(F.col(key) <= F.lit(border), 1).otherwise(0)
    minority = minority.withColumn("_copies", F.lit(gap // m) + extra)
    # Every vector has as many neighbours, so a draw is known before any neighbour is attached.
    width = min(k, m - 1)
    point = F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("_x")
    copies = minority.where(F.col("_copies") > 0).select(
        key, *ids, label, point, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    )
    if width:
        pick = F.pmod(S.stable_hash([key, "_copy"], seed, "neighbour"), F.lit(width)).cast("int")
        near = neighbours(minority, names, k, cell_rows).select("_x", F.posexplode("_near").alias("_pick", "_to"))
        drawn = copies.withColumn("_pick", pick).join(near, ["_x", "_pick"]).withColumn("_to", F.col("_to.x"))
    else:
        drawn = copies.withColumn("_to", F.col("_x"))
    drawn = drawn.withColumn("_step", S.stable_uniform([key, "_copy"], seed, "step"))
    made = [
        (F.col("_x")[i] + F.col("_step") * (F.col("_to")[i] - F.col("_x")[i])).alias(c)
        for i, c in enumerate(names)
    ]
    columns = [c for c in train.columns if c in {*ids, label, *names}]
    synthetic = drawn.select(*ids, label, *made, F.lit(True).alias(SYNTHETIC))
    return base.select(*[F.col(f"`{c}`") for c in columns], SYNTHETIC).unionByName(synthetic)


def placement_report(folds: dict[str, DataFrame], dataset: str) -> DataFrame:
    """Gate rows: synthetic rows per fold; only the training fold may hold any."""
    out = None
    for name, df in folds.items():
        made = F.col(SYNTHETIC) if SYNTHETIC in df.columns else F.lit(False)
        n = df.agg(S.count_where(made).alias("n"))
        ok = F.lit(True) if name == "train" else F.coalesce(F.col("n"), F.lit(0)) == 0
        rows = n.select(
            F.lit("smote").alias("stage"), F.lit(dataset).alias("dataset"),
            F.lit(f"train_only_placement:{name}").alias("check"),
            F.when(ok, "PASS").otherwise("FAIL").alias("status"),
            F.concat(F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" synthetic rows"))
            .alias("details"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out
