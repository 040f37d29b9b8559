"""Benchmark leaks by latent semantic retrieval.

Terms are the words of the benchmark: others can't tell its items apart. Passages of all documents give their document
frequencies, and one more pass a single-pass randomised singular value decomposition of the TF-IDF passages: every task
sums A'(A W) over its passages for a fixed random W, the sums are added up in levels, and the small factor is decomposed
on the driver. Windows of every document, at several lengths, are compared with all items by cosine in the latent space,
and each candidate is checked for a longest common subsequence and for the answer. Items are a stated query set; nothing
grows with the square of anything, and texts are never shuffled. With ``exact``, stretches with enough of an item's rare
words are candidates too, whatever their cosine: no leak is left out then, at several times the cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import added, written

PASSAGE, RANK, EXTRA = 64, 64, 16
# Terms of the decomposition at most: more words than that share terms by their hash. Bounds matrices and broadcasts.
MAX_TERMS = 1 << 16
# Items at most: every window is multiplied with every item's vector, and all items travel to the tasks.
MAX_ITEMS = 10_000
# Shortest window; the others are powers of two times it. An item is searched in windows of at least 1.5 times its words.
SHORTEST = 24
# Words of a document that are projected at a time.
STRETCH = 1 << 16
ASCII_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ASCII_WORDS).split()


def lowered(column: pa.Array) -> list[bytes]:
    return pc.cast(pc.utf8_lower(column.fill_null("")), pa.binary()).to_pylist()


@dataclass(frozen=True)
class Items:
    """Benchmark items as word numbers. ``place``: number of every word of the benchmark; its number modulo MAX_TERMS is
    its term in the decomposition."""

    ids: list
    words: list[list[int]]
    answers: list[list[int] | None]
    place: dict[bytes, int]

    @property
    def size(self) -> int:
        return min(MAX_TERMS, len(self.place))



def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, limit: int = MAX_ITEMS) -> Items:
    """The items, on the driver: a benchmark is small, and more than ``limit`` items are an error, not a cut."""
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer")]
    rows = benchmark.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} items: search them in parts")
    texts, answers = ([words_of(t) for t in lowered(pa.array([r[c] for r in rows], pa.string()))] for c in ("text", "answer"))
    place = {w: i for i, w in enumerate(sorted({w for t in texts + answers for w in t}))}
    return Items([r["id"] for r in rows], [[place[w] for w in t] for t in texts], [sorted({place[w] for w in t}) or None for t in answers], place)


def numbered(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(id, words): the number of every word of a text, -1 for words the benchmark hasn't. Written once for all passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.place.get
        for batch in batches:
            words = [np.array([get(w, -1) for w in words_of(t)], np.int32) for t in lowered(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32()))], ["id", "words"])

    kind = dict(docs.dtypes)[id_col]
    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, words array<int>"), "words")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all words, where each text starts and the end)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cells(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, term, count) of the non-zero cells, ordered by passage, and the number of passages.

    Passages are runs of PASSAGE words of one text."""
    number, bounds = _flat(column)
    n = -(-np.diff(bounds) // PASSAGE)
    known = np.flatnonzero(number >= 0)
    text = np.searchsorted(bounds, known, side="right") - 1
    passage = (np.cumsum(n) - n)[text] + (known - bounds[text]) // PASSAGE
    cell = np.sort(passage * MAX_TERMS + number[known] % MAX_TERMS)
    heads = np.flatnonzero(np.diff(cell, prepend=-1))
    cell, count = cell[heads], np.diff(np.concatenate((heads, [len(cell)])))
    return cell // MAX_TERMS, cell % MAX_TERMS, count.astype(np.float32), int(n.sum())


def inverse_frequencies(texts: DataFrame, items: Items) -> np.ndarray:
    """log((1 + N) / (1 + n)) per term, over all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(items.size, np.int64), 0
        for batch in batches:
            _, term, _, passages = _cells(batch.column(0))
            n += np.bincount(term, minlength=items.size)
            total += passages
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, items.size)), pa.array(np.concatenate(([total], n)))], ["term", "n"])

    found = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(items.size + 1)
    for row in found:
        n[row["term"] + 1] = row["n"]
    return np.log((1 + n[0]) / (1 + n[1:]))


def latent_terms(texts: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 2) -> np.ndarray:
    """(term, dimension) float32: what a word adds to the latent vector of its window.

    Single-pass randomised SVD: with Y = A'A W for a Gaussian W, A'A is about Y (W'Y)^-1 Y'; its factor's left singular
    vectors are the term directions. Directions are scaled by the inverse root of their singular value, so that the
    few frequent words that span the first ones don't drown the rest.
    """
    k = min(rank + EXTRA, max(1, items.size))
    w = np.random.default_rng(seed).normal(size=(items.size, k)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((items.size, k), np.float32)
        for batch in batches:
            passage, term, n, _ = _cells(batch.column(0))
            for low in range(0, len(term), STRETCH):
                high = low + STRETCH  # passages cut in two here count as two
                p, t = passage[low:high], term[low:high]
                x = n[low:high] * idf[t]
                starts = np.flatnonzero(np.diff(p, prepend=-1))
                row = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(p)]))))
                norm = np.sqrt(np.bincount(row, x * x))
                x = (x / np.maximum(norm, 1e-9)[row]).astype(np.float32)
                y = np.add.reduceat(w[t] * x[:, None], starts, axis=0)
                order = np.argsort(t, kind="stable")
                t = t[order]
                heads = np.flatnonzero(np.diff(t, prepend=-1))
                out[t[heads]] += np.add.reduceat(y[row[order]] * x[order][:, None], heads, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["m"])

    y = added(texts.mapInArrow(run, "m binary"), (items.size, k))
    small = w.T.astype(float) @ y
    small = (small + small.T) / 2
    value, vector = np.linalg.eigh(small)
    good = value > value.max() * 1e-7 if value.max() > 0 else np.zeros(len(value), bool)
    if not good.any():
        return np.zeros((items.size, 1), np.float32)
    u, s, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    return (idf[:, None] * u / np.sqrt(np.maximum(s, 1e-9))).astype(np.float32)


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item of ``size`` words (bit masks of each word's places) and a
    list of words: one addition per word on whole numbers of ``size`` bits."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass(frozen=True)
class Checker:
    """Exact checks of an item of ``size`` words: ``least`` of them in order within ``span`` words, and half the answer."""

    size: int
    masks: dict[int, int]  # word -> its places in the item
    answer: frozenset
    least: int
    span: int

    @classmethod
    def of(cls, words: list[int], answer: list[int] | None, idf: np.ndarray, share: float) -> Checker:
        masks: dict[int, int] = {}
        for i, x in enumerate(words):
            masks[x] = masks.get(x, 0) | 1 << i
        # Without an answer of its own, the rarest quarter of an item's words stands for it.
        rare = answer or sorted(masks, key=lambda x: (-idf[x % MAX_TERMS], x))[:max(3, -(-len(masks) // 4))]
        n = len(words)
        short = n < 8  # a few common words occur in order by chance: short items count only as a whole
        return cls(n, masks, frozenset(rare), n if short else int(np.ceil(share * n)), n if short else -(-3 * n // 2))

    def find(self, around: np.ndarray) -> tuple[int, int] | None:
        """(words in common, place) of the best stretch of ``span`` words that passes, None if none does."""
        # Words of the item up to each place: stretches with too few are passed over.
        inside = np.isin(around, list(self.masks))
        total = np.concatenate(([0], np.cumsum(inside)))
        best, listed = None, around.tolist()
        starts = np.arange(max(1, len(listed) - self.span + 1))
        # The best stretch may as well begin with a word of the item or its answer, or be the last one.
        telling = inside | np.isin(around, list(self.answer))
        may = (total[np.minimum(starts + self.span, len(listed))] - total[starts] >= self.least) & (telling[starts] | (starts == starts[-1]))
        after = 0
        for at in starts[may].tolist():
            if at < after:
                continue
            part = listed[at:at + self.span]
            n = common_subsequence(self.masks, self.size, part)
            # A start one word on has at most one word more in common: the next that can be better is so far away.
            after = at + max(self.least, best[0] + 1 if best else 0) - n
            if n >= self.least and (best is None or n > best[0]) and 2 * len(self.answer.intersection(part)) >= len(self.answer):
                best = n, at
        return best


# Machine words of the print of a stretch.
PRINT = 8


def print_bits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(machine word, bit) of each word number in a print."""
    place = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


@dataclass(frozen=True)
class SparseBits:
    """Whole numbers to 64 bits, all others to 0: a table with open addressing, a quarter full at most."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, bits: dict[int, int]) -> SparseBits:
        keys = np.full(1 << max(4, (4 * len(bits)).bit_length()), -1, np.int64)
        table = cls(keys, np.zeros(len(keys), np.uint64))
        left = np.fromiter(bits, np.int64, len(bits))
        value = np.fromiter(bits.values(), np.uint64, len(bits))
        slot = table._slots(left)
        while len(left):
            free = keys[slot] == -1
            keys[slot[free]] = left[free]  # of several for a slot, the last one gets it
            done = keys[slot] == left
            table.values[slot[done]] = value[done]
            left, value, slot = left[~done], value[~done], (slot[~done] + 1) % len(keys)
        return table

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], np.uint64(0))
        left = np.flatnonzero((found != key) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


@dataclass(frozen=True)
class Bits:
    """What has to be in the words around a window before an item is compared in full, for the items of one window size.

    ``bits``: (item, word number) to a bit for each of the item's 32 rarest words, and above them one for each of up to
    32 answer words. At most ``missing`` of the first kind may be absent, and at least ``needed`` of the second present;
    both follow from the checks, so nothing that would pass them is lost. Words outside the benchmark are left out.
    ``print``: the rare words of an item, each as one of 64 ``PRINT`` bits, of which ``overlap`` have to be set.
    """

    bits: SparseBits
    n_words: int
    missing: np.ndarray
    needed: np.ndarray
    least: np.ndarray
    print: np.ndarray
    overlap: np.ndarray

    @classmethod
    def of(cls, checkers: list[Checker], idf: np.ndarray, n_words: int) -> Bits:
        word: dict[int, int] = {}
        missing, needed, overlap = [], [], []
        prints = np.zeros((len(checkers), PRINT), np.uint64)
        for i, c in enumerate(checkers):
            rare = sorted(c.masks, key=lambda x: (-idf[x % MAX_TERMS], x))[:32]
            answer = sorted(c.answer)[:32]
            for j, x in [*enumerate(rare), *enumerate(answer, 32)]:
                word[i * n_words + x] = word.get(i * n_words + x, 0) | 1 << j
            missing.append(len(rare) - (c.size - c.least))
            # Of a longer answer, half may be outside the words that have a bit.
            needed.append(max(0, -(-len(c.answer) // 2) - (len(c.answer) - len(answer))))
            cell, bit = print_bits(np.array(rare, np.int64))
            np.bitwise_or.at(prints[i], cell, bit)
            overlap.append(int(np.bitwise_count(prints[i]).sum()) - (c.size - c.least))
        return cls(SparseBits.of(word), n_words, np.array(missing), np.array(needed), np.array([c.least for c in checkers]),
                   prints, np.array(overlap))

    def may_pass(self, around: np.ndarray, window: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs of a window and an item may pass by their prints: words that share a bit only add to it."""
        out = np.zeros(len(item), bool)
        for at in range(0, len(item), 1 << 14):
            w, i = window[at:at + (1 << 14)], item[at:at + (1 << 14)]
            out[at:at + (1 << 14)] = np.bitwise_count(around[w] & self.print[i]).sum(axis=1, dtype=np.int64) >= self.overlap[i]
        return out

    def pass_on(self, item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which pairs of an item and the words from ``low`` to ``high`` may pass."""
        out = np.zeros(len(item), bool)
        for at in range(0, len(item), 4096):
            i, a, n = item[at:at + 4096], low[at:at + 4096], (high - low)[at:at + 4096]
            starts = np.cumsum(n) - n
            place = np.repeat(a - starts, n) + np.arange(n.sum())
            seen = np.bitwise_or.reduceat(self.bits[np.repeat(i, n) * self.n_words + words[place]], starts)
            rare = np.bitwise_count(seen & np.uint64(0xFFFFFFFF))
            answer = np.bitwise_count(seen >> np.uint64(32))
            out[at:at + 4096] = (rare >= self.missing[i]) & (answer >= self.needed[i])
        return out


@dataclass(frozen=True)
class Lists:
    """Which items of one window size a word is among the rare ones of, word after word, and how many different rare words
    a stretch needs to pass. Of each item so many are rare that no stretch passes without one."""

    first: np.ndarray
    item: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, checkers: list[Checker], idf: np.ndarray, n_words: int) -> Lists:
        pairs, needed = [], []
        for i, c in enumerate(checkers):
            absent = c.size - c.least
            rare = sorted(c.masks, key=lambda x: (-idf[x % MAX_TERMS], x))[:max(32, absent + 8)]
            pairs += [(x, i) for x in rare]
            needed.append(max(1, len(rare) - absent))
        word, item = np.array(sorted(pairs), np.int64).T
        return cls(np.searchsorted(word, np.arange(n_words + 1)), item, np.array(needed))

    def near(self, words: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, cell) where a stretch of at most three cells that passes may have its first rare word; ``cell`` of each
        word, of ``cells``, of which four are empty after each piece."""
        n = self.first[words + 1] - self.first[words]
        place = np.repeat(self.first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = self.item[place] * cells + np.repeat(cell, n)
        key = np.unique(key * (len(self.first) - 1) + np.repeat(words, n)) // (len(self.first) - 1)
        key, count = np.unique(key, return_counts=True)
        total, padded = count.copy(), np.concatenate((key, [-1]))
        for j in (1, 2, 3):
            at = np.searchsorted(key, key + j)
            total += np.where(padded[at] == key + j, np.concatenate((count, [0]))[at], 0)
        key = key[total >= self.needed[key // cells]]
        return key // cells, key % cells


def pieces(bounds: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups (text, low, high) of pieces of texts, about STRETCH words a group; a longer text is cut into pieces that
    overlap, so that no word is left out and memory doesn't grow with it."""
    group: list[tuple[int, int, int]] = []
    words = 0
    for text, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for low in range(a, b, STRETCH):
            high = min(b, low + STRETCH + overlap)
            group.append((text, low, high))
            words += high - low
            if words >= STRETCH:
                yield tuple(np.array(group, np.int64).T)
                group, words = [], 0
            if high == b:
                break
    if group:
        yield tuple(np.array(group, np.int64).T)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", answer_col: str | None = None, cosine: float = 0.3, share: float = 0.7, exact: bool = False,
) -> DataFrame:
    """(id, item_id, cosine, n_common, n_item_words, word_start) per document and item found in it.

    A leak is a stretch of at most 1.5 times the item's words that has ``share`` of them in order (all of them, in a row,
    for items of under 8 words) and at least half of the answer's words. It is searched where the cosine of a window and
    the item is at least ``cosine``, or everywhere with ``exact``. Null and wordless texts and items have no
    leaks; repeated rows are found each; an empty benchmark or table gives no rows. Other columns are not read. Whole
    texts are searched; a text's words are projected a stretch at a time.
    """
    items = benchmark_items(benchmark, item_col, item_text_col, answer_col)
    kinds = f"id {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}"
    schema = f"{kinds}, cosine double, n_common long, n_item_words long, word_start long"
    if not items.place:
        return docs.sparkSession.createDataFrame([], schema)
    rows = numbered(docs, items, id_col, text_col)
    texts = rows.select("words")
    idf = inverse_frequencies(texts, items)
    latent = latent_terms(texts, items, idf)
    checkers = [Checker.of(w, a, idf, share) if w else None for w, a in zip(items.words, items.answers)]
    # Items by the shortest window that holds them wherever it starts.
    scales: dict[int, list[int]] = {}
    for i, words in enumerate(items.words):
        if len(words):
            size = SHORTEST
            while size * 2 < len(words) * 3:
                size *= 2
            scales.setdefault(size, []).append(i)
    vectors, bits, lists = {}, {}, {}
    for size, some in scales.items():
        if exact:
            lists[size] = Lists.of([checkers[i] for i in some], idf, len(items.place))
        bits[size] = Bits.of([checkers[i] for i in some], idf, len(items.place))
        v = np.array([latent[np.array(items.words[i]) % MAX_TERMS].sum(axis=0) for i in some])
        vectors[size] = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)
    item_type = docs.sparkSession.createDataFrame([], kinds).toArrow().schema.field("item_id").type

    rows_of = np.vstack((latent, np.zeros((1, latent.shape[1]), np.float32)))
    widest = max(scales)
    ratio = widest // SHORTEST  # a power of two

    def candidates(number: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(item, piece, start, end, cosine) of the windows near an item, with the words a third of a window around.

        ``lows`` and ``highs`` bound pieces of texts in ``number``. A piece is cut into cells of a third of the shortest
        window; longer windows are made of twice as long cells, and so on; a window is three cells.
        """
        cell = SHORTEST // 3
        count = -(-(highs - lows) // (cell * ratio)) * ratio
        first = np.cumsum(count) - count
        at = np.concatenate([np.arange(a, b) for a, b in zip(lows, highs)])
        piece = np.repeat(np.arange(len(lows)), highs - lows)
        known = number[at] >= 0
        at, piece = at[known], piece[known]
        words = number[at]
        slots = np.full((int(count.sum()) + 2 * ratio) * cell, len(latent))  # a row of zeros for all else
        slots[first[piece] * cell + at - lows[piece]] = words % MAX_TERMS
        slots = slots.reshape(-1, cell)
        sums = rows_of[slots[:, 0]]
        for j in range(1, cell):
            sums += rows_of[slots[:, j]]
        prints = np.zeros((len(sums), PRINT), np.uint64)
        column, bit = print_bits(words)
        np.bitwise_or.at(prints.reshape(-1), (first[piece] + (at - lows[piece]) // cell) * PRINT + column, bit)
        size = SHORTEST
        while True:
            if size in scales:
                step, n = size // 3, count * SHORTEST // size
                total = int(n.sum())
                v = sums[:total] + sums[1:total + 1] + sums[2:total + 2]
                of = np.repeat(np.arange(len(lows)), n)
                start = lows[of] + (np.arange(total) - np.repeat(np.cumsum(n) - n, n)) * step
                norm = np.linalg.norm(v, axis=1)
                # A window's print with a cell before it and one after.
                wide = np.concatenate((prints[:1] * 0, prints, prints[:2] * 0))
                around = wide[:total] | wide[1:total + 1] | wide[2:total + 2] | wide[3:total + 3] | wide[4:total + 4]
                for low in range(0, total, 4096):
                    near = v[low:low + 4096] @ vectors[size]
                    w, i = np.nonzero(near >= cosine * np.maximum(norm[low:low + 4096, None], 1e-9))
                    may = bits[size].may_pass(around, w + low, i)
                    w, i = w[may], i[may]
                    near, w = near[w, i] / norm[low + w], w + low
                    # A window that runs over the end of its piece sees words of the next: the checks don't.
                    a, b = np.maximum(start[w] - step, lows[of[w]]), np.minimum(start[w] + size + step, highs[of[w]])
                    c, d = np.searchsorted(at, a), np.searchsorted(at, b)
                    some = np.flatnonzero(d - c >= bits[size].least[i])
                    w, i, a, b, near = w[some], i[some], a[some], b[some], near[some]
                    for j in np.flatnonzero(bits[size].pass_on(i, words, c[some], d[some])):
                        yield scales[size][i[j]], int(of[w[j]]), int(a[j]), int(b[j]), float(near[j])
            if size == widest:
                return
            size *= 2
            sums = sums[0::2] + sums[1::2]
            prints = prints[0::2] | prints[1::2]

    def others(number: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """As ``candidates``, by rare words in place of the cosine: no stretch that passes is left out."""
        at = np.concatenate([np.arange(a, b) for a, b in zip(lows, highs)])
        piece = np.repeat(np.arange(len(lows)), highs - lows)
        known = number[at] >= 0
        at, piece = at[known], piece[known]
        for size, some in scales.items():
            step = size // 3
            count = -(-(highs - lows) // step) + 4
            first = np.cumsum(count) - count
            found, cell = lists[size].near(number[at].astype(np.int64), first[piece] + (at - lows[piece]) // step, int(count.sum()))
            of = np.searchsorted(first, cell, side="right") - 1
            start = lows[of] + (cell - first[of]) * step
            for i, p, a in zip(found.tolist(), of.tolist(), start.tolist()):
                low, high = max(a - size, int(lows[p])), min(a + size + step, int(highs[p]))
                words = number[a:min(a + size, high)]
                v = latent[words[words >= 0] % MAX_TERMS].sum(axis=0)
                yield some[i], p, low, high, float(v @ vectors[size][:, i] / max(float(np.linalg.norm(v)), 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, bounds = _flat(batch.column(1))
            best: dict[tuple[int, int], tuple] = {}
            for texts, lows, highs in pieces(bounds, 4 * widest):
                found = candidates(number, lows, highs)
                for item, piece, low, high, c in chain(found, others(number, lows, highs)) if exact else found:
                    row, hit = int(texts[piece]), checkers[item].find(number[low:high])
                    if hit and ((row, item) not in best or hit[0] > best[row, item][1]):
                        best[row, item] = c, hit[0], checkers[item].size, low + hit[1] - int(bounds[row])
            keys = sorted(best)
            values = [best[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([items.ids[k[1]] for k in keys], item_type),
                 pa.array([v[0] for v in values], pa.float64()), *[pa.array([v[j] for v in values], pa.int64()) for j in (1, 2, 3)]],
                ["id", "item_id", "cosine", "n_common", "n_item_words", "word_start"])

    return rows.mapInArrow(run, schema)
