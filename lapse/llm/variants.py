"""Spelling variants: words of a corpus at one edit from each other, found with a bit-sliced position index.

For a block of words the index holds, per position and letter, the set of words with that letter there, one bit a word.
For a query of L letters two families of sets are carried along its letters: the words that agree so far, and those that
agree but for one replaced letter, or, with the positions shifted by one, for one inserted letter. A letter costs a few
operations on whole machine words, for all queries of a block at once; nothing is compared word by word.

Words at one edit, the shorter of L letters, share their first or their last L // 2 letters. Words meet in a task by these
halves; a half that many words share is cut into blocks of the index, and its queries go to each. A pair that shares the
first half is taken there only, so every pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import octets, strings, written

LETTERS = "a-zÀ-ÿ"
# A run of a document is misspelled on purpose where this divides its checksum.
SLIP = 199
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
# Words a task counts before it passes the counts on.
HELD_WORDS = 1 << 17
# Letters of a block's words: about so many words of 16 letters are searched at a time.
BLOCK_LETTERS = 4096 * 16
# A half with more letters than this is cut into several blocks.
HALF_LETTERS = 4 * BLOCK_LETTERS
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slipped(run: str, prefix: int) -> str:
    """The run, without one letter where its checksum, carried on from ``prefix``, says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of the words of at least ``min_letters`` letters that occur ``min_count`` times or more."""
    runs = re.compile(f"[{LETTERS}]{{{min_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(strings(batch.column(0)), octets(batch.column(1))):
                prefix = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(runs.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                    word = slipped(word, prefix)
                    if len(word) >= min_letters:
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD_WORDS:
                    yield out()
                    total.clear()
        yield out()

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over words of ``size`` and ``size + 1`` letters, built position by position as queries pass."""

    def __init__(self, words: list[str], size: int):
        self.size, self.n = size, len(words)
        codes = _codes(words, size + 1)
        self.alphabet = np.unique(codes[codes > 0])
        self.codes = np.searchsorted(self.alphabet, codes)
        self.codes[codes == 0] = len(self.alphabet)  # no letter: the position after a shorter word
        self.width = -(-self.n // 64)
        self.long = self._bits(codes[:, size] > 0)

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        """Bitsets of boolean rows over the words."""
        wide = np.zeros((*rows.shape[:-1], self.width * 64), bool)
        wide[..., :self.n] = rows
        return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)

    def _letters(self, place: int) -> np.ndarray:
        """The words with each letter of the alphabet at ``place``; the last row, for any other letter, is empty."""
        rows = np.zeros((len(self.alphabet) + 2, self.n), bool)
        rows[self.codes[:, place], np.arange(self.n)] = True
        rows[len(self.alphabet):] = False
        return self._bits(rows)

    def near(self, queries: list[str], shared: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) at exactly one edit. ``shared``: only words with the query's first half, else only the others.

        Queries have ``size`` letters. After i of them, ``same`` holds the words that begin with them, ``replaced`` those
        that do but for one letter, and ``inserted`` those that do with one letter more, whose positions are one ahead.
        """
        codes = _codes(queries, self.size)
        place = np.searchsorted(self.alphabet, codes)
        known = np.concatenate((self.alphabet, [0]))[place] == codes
        letter = np.where(known, place, len(self.alphabet) + 1)
        full = self._bits(np.ones(self.n, bool))
        same = np.tile(full, (len(queries), 1))
        replaced = np.zeros_like(same)
        inserted = np.tile(self.long, (len(queries), 1))
        here, half = self._letters(0), None
        for i in range(self.size):
            ahead = self._letters(i + 1)
            has, after = here[letter[:, i]], ahead[letter[:, i]]
            replaced = (replaced & has) | (same & ~has)
            same &= has
            inserted = (inserted & after) | (same & self.long)
            here = ahead
            if i + 1 == self.size // 2:
                half = same.copy()
        found = (replaced & ~self.long) | inserted
        found &= half if shared else ~half
        # Only the machine words with a bit are opened.
        row, cell = np.nonzero(found)
        bits = np.unpackbits(found[row, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return row[at], cell[at] * 64 + bit


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points, one row per word, zero after its end."""
    return np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)


def halves(words: DataFrame, min_letters: int) -> DataFrame:
    """(size, first, key, role, word, n): every word where it may meet others. A word of L letters is in the index (role 0) of
    sizes L and L - 1, and a query (role 1) of size L, by its first and by its last half."""
    size = F.length("word")
    places = [F.struct((size - k).alias("size"), F.lit(first).alias("first"), F.lit(role).alias("role"))
              for first in (True, False) for k, role in ((0, 0), (0, 1), (1, 0))]
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("at")).select("word", "n", "at.*").where(F.col("size") >= min_letters)
    half = F.floor(F.col("size") / 2).cast("int")
    part = F.when(F.col("first"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.length("word") - half + 1, half))
    return rows.select("size", "first", F.xxhash64("size", "first", part).alias("key"), "role", "word", "n")


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, near, near_n): every word with every other at exactly one inserted, deleted or replaced letter."""
    rows = written(halves(words, min_letters), "halves")
    large = (rows.where("role = 0").groupBy("key").agg(F.sum(F.length("word")).alias("letters")).where(F.col("letters") > HALF_LETTERS)
             .select(F.col("key").alias("large"), F.ceil(F.col("letters") / HALF_LETTERS).cast("int").alias("parts")))
    # Few by their definition, and written so that a join by sort could be split.
    large = written(large, "large")
    cut = rows.join(large, F.col("key") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    parts = F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = cut.select("size", "first", "key", F.explode(parts).alias("part"), "parts", "role", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Blocks()
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                yield from search.add(*row)
        yield from search.end()

    return (placed.repartition("size", "first", "key", "part").sortWithinPartitions("size", "first", "key", "part", "role")
            .mapInArrow(run, "word string, near string, near_n long"))


class _Blocks:
    """Rows in order of (size, first, key, part, role) as blocks: whole groups share an index while it is small."""

    def __init__(self):
        self.group = self.kind = None
        self.alone = False
        self.words: list[tuple[str, int]] = []
        self.queries: list[tuple[str, int]] = []
        self.index: PositionIndex | None = None

    def add(self, size: int, first: bool, key: int, part: int, parts: int, role: int, word: str, n: int) -> Iterator[pa.RecordBatch]:
        group = (size, first, key, part)
        if group != self.group:
            full = len(self.words) * size >= BLOCK_LETTERS
            # The parts of one half have the same queries: they never share an index.
            if self.kind != (size, first) or full or self.alone or parts > 1:
                yield from self.end()
            self.group, self.kind, self.alone = group, (size, first), parts > 1
        if role == 0:
            self.words.append((word, n))
            self.index = None
        else:
            self.queries.append((word, n))
            if len(self.queries) * size >= BLOCK_LETTERS:
                yield from self.search()

    def search(self) -> Iterator[pa.RecordBatch]:
        if self.queries and len(self.words) > 1 or self.queries and self.alone and self.words:
            size, first = self.kind
            self.index = self.index or PositionIndex([w for w, _ in self.words], size)
            # Every state of a search has a bit per query and word: few queries at a time against a large index.
            step = max(64, (1 << 24) // max(64, len(self.words)))
            for low in range(0, len(self.queries), step):
                some = self.queries[low:low + step]
                q, w = self.index.near([x for x, _ in some], first)
                if len(q):
                    a, b = [some[i] for i in q], [self.words[i] for i in w]
                    # A longer word is no query here: its pair is given both ways.
                    back = [(y, x) for x, y in zip(a, b) if len(y[0]) > size]
                    a, b = a + [x for x, _ in back], b + [y for _, y in back]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in a]), pa.array([x for x, _ in b]), pa.array([n for _, n in b], pa.int64())],
                        ["word", "near", "near_n"])
        self.queries = []

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.search()
        self.words, self.index, self.alone = [], None, False


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps; counts grow along a chain by
    a factor, so chains are short."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the corpus.

    Words are runs of letters in lower case, with the letter left out that ``slipped`` names. A word's form is its near
    word of the largest count (of equal ones the smallest), if it occurs ``ratio`` times as often or more; its root is
    the last form of that chain. A null text has no words; a null id counts as an empty one; repeated rows count each; a
    table without words gives no rows. Runs and texts of any length are whole. Other columns are not read.
    """
    words = written(vocabulary(docs, id_col, text_col, min_letters, min_count), "words")
    near = near_words(words, min_letters).groupBy(F.col("word").alias("of")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    best = F.col("best.n")
    formed = written(words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-best >= ratio * F.col("n"), F.col("best.word")).alias("form"), F.when(-best >= ratio * F.col("n"), -best).alias("form_n")), "forms")
    roots = followed(formed.where("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
