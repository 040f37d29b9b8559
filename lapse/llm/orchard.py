"""Vector compression by product codes, with Orchard's search for the nearest codebook entry.

Vectors are cut into equal parts with a codebook of integer entries each, improved in rounds: one pass over the vectors
assigns every part to its nearest entry and adds up the parts of each entry per task; the sums are added in levels.
The search keeps, for every entry, the others in order of their distance to it. From the current entry's list entries are
tried in turn; a nearer one becomes current and its list is walked from its head; what was tried is marked; the walk ends
where the list goes beyond twice the current distance, since nothing further can be nearer. Distances are whole numbers,
so the result is that of trying all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Components are held so small that no squared distance of a part is above this: four parts fit a long.
LARGEST = 1 << 60
# Vectors searched at a time, and list places tried in one step.
BLOCK, STEP = 2048, 8


class Orchard:
    """Exact nearest entry of one codebook, the lowest index among equally near."""

    def __init__(self, entries: np.ndarray):
        """``entries``: whole numbers, one row per entry."""
        self.entries = entries
        d = self._squares(entries[:, None, :] - entries[None, :, :])
        # Each list starts with its own entry or an equal one; stable, so that ties go by index.
        self.order = np.argsort(d, axis=1, kind="stable")
        self.far = np.take_along_axis(d, self.order, axis=1)

    @staticmethod
    def _squares(x: np.ndarray) -> np.ndarray:
        return np.einsum("...i,...i->...", x, x)

    def search(self, queries: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each query; all walk their lists at once."""
        n, size = len(queries), len(self.entries)
        current = np.full(n, start, np.int64)
        best = self._squares(queries - self.entries[start])
        marked = np.zeros((n, size), bool)
        marked[:, start] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        ahead = np.arange(STEP)
        while len(walking):
            at = place[walking, None] + ahead
            within = at < size
            at = np.minimum(at, size - 1)
            here = current[walking, None]
            # Twice the distance is four times its square; entries at exactly that bound may still tie.
            within &= self.far[here, at] <= 4 * best[walking, None]
            entry = self.order[here, at]
            # The list is sorted: once it is too far, it stays so.
            ends = ~within[:, -1]
            row, col = np.nonzero(within & ~marked[walking[:, None], entry])
            found = entry[row, col]
            marked[walking[row], found] = True
            d = np.full(entry.shape, np.iinfo(np.int64).max)
            d[row, col] = self._squares(queries[walking[row]] - self.entries[found])
            # The least distance, and of equal ones the lowest index.
            low = d.min(axis=1)
            which = np.where(d == low[:, None], entry, size).min(axis=1)
            now, index = best[walking], current[walking]
            nearer = (low < now) | ((low == now) & (which < index))
            place[walking] += STEP
            moved = walking[nearer]
            best[moved], current[moved], place[moved] = low[nearer], which[nearer], 0
            walking = walking[nearer | ~ends]
        return current, best


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): whole-number components of the rows whose vector has only finite ones."""
    most = F.floor(F.sqrt(F.lit(float(LARGEST)) * PARTS / F.size(vector_col)) / 2).cast("double")
    whole = F.transform(vector_col, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, most), -most)).cast("long"))
    infinite = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = (F.size(vector_col) >= PARTS) & (F.size(vector_col) % PARTS == 0) & ~infinite
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v"))


def first_codebooks(kept: DataFrame, entries: int) -> np.ndarray:
    """(part, entry, component) of the vectors with the smallest ids; vectors of equal ids in their own order, null ids not
    at all."""
    rows = kept.where("id is not null").orderBy("id", "v").limit(entries).select("v").collect()
    first = np.array([r["v"] for r in rows], np.int64)
    return first.reshape(len(rows), PARTS, -1).transpose(1, 0, 2) if rows else np.zeros((PARTS, 0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            block = batch.slice(low, BLOCK)
            flat = block.column("v").flatten().to_numpy()
            yield block, flat.reshape(block.num_rows, PARTS, dim // PARTS)


def added_longs(parts: DataFrame, size: int, fan_in: int = 16) -> np.ndarray:
    """Sum of arrays of ``size`` longs, one per row: added in levels, so that the driver adds ``fan_in`` at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                out += np.frombuffer(value, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["m"])

    n = parts.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(run, "m binary")
    out = np.zeros(size, np.int64)
    for row in parts.collect():
        out += np.frombuffer(row["m"], np.int64)
    return out


def improved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry the mean of its parts, rounded down; entries without parts stay."""
    dim, (n_parts, size, width) = books.shape[0] * books.shape[2], books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Orchard(b) for b in books]
        out = np.zeros((n_parts, size, width + 1), np.int64)
        for _, block in _blocks(batches, dim):
            for p, tree in enumerate(trees):
                entry, _ = tree.search(block[:, p])
                np.add.at(out[p], entry, np.concatenate((block[:, p], np.ones((len(entry), 1), np.int64)), axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["m"])

    sums = added_longs(kept.select("v").mapInArrow(run, "m binary"), n_parts * size * (width + 1)).reshape(n_parts, size, width + 1)
    n = sums[:, :, -1:]
    return np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) per kept vector, and the codebooks (part, entry, component).

    Components are floor(1024 x), held to 2**27 in size for parts of 16, to less in longer ones. Rows are dropped whose vector is null, holds null or non-finite
    components, has no positive multiple of 4 components, or has another number of them than the first kept vector (by
    id). Rows with a null id or label stay, but null ids give no codebook entry; repeated rows stay repeated.
    Fewer than ``entries`` rows give fewer entries, equal entries are told apart by index; an empty table, or one of null
    ids only, has no codebook and gives no rows. Other columns are not read. ``entries`` is at most 256: two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = written(kept_vectors(vectors, id_col, vector_col, label_col), "vectors")
    books = first_codebooks(_of_one_size(kept), entries)
    dim = PARTS * books.shape[2]
    same = kept.where(F.size("v") == dim) if dim else kept.where("false")
    if dim:
        for _ in range(rounds):
            books = improved(same, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Orchard(b) for b in books] if dim else []
        for block, parts in _blocks(batches, dim):
            found = [tree.search(parts[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return same.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), books


def _of_one_size(kept: DataFrame) -> DataFrame:
    """The vectors as long as the one with the smallest id."""
    first = kept.where("id is not null").orderBy("id", "v").limit(1).select(F.size("v").alias("n")).collect()
    return kept.where(F.size("v") == first[0]["n"]) if first else kept.where("false")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors summed over equal labels; null labels are equal."""
    coded = written(coded, "codes")
    # Written on its own, so that the join back has two plain shuffles: a hot label is split where it is too large.
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    totals = totals.select(F.col("label").alias("total_label"), "label_error")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("total_label"))).drop("total_label")
