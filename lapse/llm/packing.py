"""Packing token sequences into fixed windows by non-negative least squares over length combinations.

Texts are cut into full windows and a rest. The histogram of rests is matched by repeat counts of shallow
combinations (up to three pieces that fill a window exactly), found by non-negative least squares and rounded down;
the rests left over are packed greedily, longest first. All of it works on counts per length. Pieces are numbered
within their length by counts per task and their running sums, so no length, however common, meets in one task.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import strings, written

WINDOW = 2048
# How byte-level files of this kind split a text before merging (the ``use_regex`` of their ByteLevel step).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_stand_ins() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level files: printable Latin-1 as it is, all others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(c) for b, c in [*zip(plain, plain), *zip(other, range(256, 512))]}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file whose ids follow the order of its merges; None for any other.

    For such a file the ids of a text are those of merging by lowest id first, which is much faster from ranks.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    level = model.get("pre_tokenizer") or {}
    if model["model"]["type"] != "BPE" or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or model.get("normalizer"):
        return None
    stand_in = {c: b for b, c in byte_stand_ins().items()}
    vocabulary = model["model"]["vocab"]
    for i, pair in enumerate(model["model"]["merges"]):
        merged = "".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)
        if vocabulary.get(merged) != 256 + i:
            return None
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(stand_in[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class Encoder:
    """Token ids of ``tokenizers`` without special tokens, as little-endian unsigned 32-bit bytes.

    Merged by rank where the file allows it: the same ids in a quarter of the time. A test holds both against each other.
    Runs of about a million spaces and more are beyond that way's splitter; such texts go to the library, and so do texts
    that hold an added token of the file, which is one id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.ranked:
            return [self._merged(t) for t in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, text: str) -> bytes:
        try:
            if not any(t in text for t in self.added):
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:
            pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def cut_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1,
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, part, nth): full windows, then the rest, of each text's ids
    and ``end_id``. ``nth`` counts the pieces of that length within the task ``part``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            row, start, length, crc, total, nth = ([] for _ in range(6))
            for i, ids in enumerate(encoder(strings(batch.column(1)))):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at:at + 4 * window]
                    n = len(piece) // 4
                    row.append(i)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                 pa.array([part] * len(row), pa.int64()), pa.array(nth, pa.int64())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")


def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of lengths that sum to ``window``; 0 is no piece. Whole windows are left out."""
    rows = []
    for a in range((window + 2) // 3, window):
        b = np.arange((window - a + 1) // 2, min(a, window - a) + 1)
        rows.append(np.column_stack((np.full(len(b), a), b, window - a - b)))
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, window: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, whole repeats) that use no more pieces of a length than there are.

    Least squares |A x - h| with x >= 0 by accelerated projected gradients over all combinations of lengths that
    occur; short lengths weigh less, they fill gaps easily. Repeats are rounded down; where the pieces allow, up.
    """
    combos = combinations(window)
    h = histogram.astype(float)
    have = (h > 0) | (np.arange(window + 1) == 0)
    combos = combos[have[combos].all(axis=1)]
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    weight = np.sqrt(np.arange(window + 1) / window)
    weight[0] = 0.0
    flat = combos.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), window + 1)

    # The largest eigenvalue is at most the largest row sum of A'A.
    used = np.bincount(flat, minlength=window + 1)
    step = 1.0 / float(((weight ** 2)[combos] * used[combos]).sum(axis=1).max())
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(steps):
        error = weight ** 2 * (forward(y) - h)
        error[0] = 0.0
        new = np.maximum(0.0, y - step * error[combos].sum(axis=1))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / following * (new - x)
        x, t = new, following
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(combos), np.int64)
    # Largest repeats first; each is held to the pieces that are left.
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.25:
            break
        need = Counter(int(n) for n in combos[i] if n)
        take = min([int(np.ceil(x[i] - 0.25))] + [int(left[n]) // k for n, k in need.items()])
        if take > 0:
            repeats[i] = take
            for n, k in need.items():
                left[n] -= k * take
    return combos[repeats > 0], repeats[repeats > 0]


def greedy(left: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Residual pieces: the longest opens a window, the longest that still fits joins it; equal windows are counted."""
    left = left.copy()
    rows, repeats = [], []
    lengths = [int(n) for n in np.flatnonzero(left)]  # ascending; the used up go
    while lengths:
        room, row = window, []
        at = len(lengths) - 1
        taken: Counter = Counter()
        while room and at >= 0:
            at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
            while at >= 0 and left[lengths[at]] <= taken[lengths[at]]:
                at -= 1
            if at < 0:
                break
            n = lengths[at]
            take = min(room // n, int(left[n]) - taken[n])
            taken[n] += take
            row += [n] * take
            room -= n * take
        times = min(int(left[n]) // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
        rows.append(row)
        repeats.append(times)
    return rows, repeats


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths of a window's pieces, how many such windows); every piece of the histogram is in one."""
    whole = [([window], int(histogram[window]))] if histogram[window] else []
    rests = histogram.copy()
    rests[window] = 0
    combos, repeats = repeat_counts(rests, window)
    rows = [([int(n) for n in c if n], int(k)) for c, k in zip(combos, repeats)]
    for row, k in rows:
        for n in row:
            rests[n] -= k
    more, times = greedy(rests, window)
    return whole + rows + list(zip(more, times))


def slots(rows: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For every run of equal slots (length, first, last, sequence, step of ranks a window, offset): the pieces of a
    length, ranked from 0, fill the runs in turn; ``sequence`` is that of the run's first window, ``step`` how many
    pieces of the length lie one after the other in each of its windows."""
    used: Counter = Counter()
    out, sequence = [], 0
    for row, times in rows:
        offset = 0
        for n, k in Counter(row).items():
            out.append((n, used[n], used[n] + k * times, sequence, k, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padding) per piece.

    Every row of ``docs`` is packed, repeated rows too; a null text is empty and has the end id alone; an empty table
    gives no pieces. A window is padded to its size unless its tokens are a power of two. To the driver come one count
    per length, and back one row per run of equal slots: both grow with ``window``, not with the documents.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, id_col, text_col, window), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    rows = plan(histogram, window)
    fill = np.array([sum(row) for row, _ in rows], np.int64)
    first = np.cumsum([0] + [k for _, k in rows])
    runs = [(*map(int, r), int(fill[np.searchsorted(first, r[3], side="right") - 1])) for r in slots(rows)]
    # Runs of a length in one row: a piece finds its run by place, no range join.
    table = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 1, 0, 0)], "length long, low long, high long, first long, step long, at long, sequence_tokens long")
    grouped = table.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("low", "high", "first", "step", "at", "sequence_tokens"))).alias("runs"))
    placed = (pieces.join(offsets, ["length", "part"])
              .select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
              .join(F.broadcast(grouped), "length")
              .select("*", _find("runs", "rank").alias("r")))
    nth = F.col("rank") - F.col("r.low")
    power = F.expr("bit_count(r.sequence_tokens) = 1")
    return placed.select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("r.first") + F.floor(nth / F.col("r.step"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + F.pmod(nth, F.col("r.step")) * F.col("length")).cast("long").alias("offset"),
        F.col("r.sequence_tokens").alias("sequence_tokens"),
        F.when(power, F.lit(0)).otherwise(window - F.col("r.sequence_tokens")).cast("long").alias("padding"))


def _find(runs: str, rank: str):
    """The run that holds the rank."""
    return F.get(F.filter(runs, lambda r: (r["low"] <= F.col(rank)) & (F.col(rank) < r["high"])), F.lit(0))
