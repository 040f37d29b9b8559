"""Best-fit packing after a Martello-Toth dominance reduction.

Texts become token ids; only texts longer than a window are cut. A set of at most three pieces that holds piece ``j`` is
fixed for good where it dominates every other set that could be packed with ``j``: the other set's pieces can be put in
the places of the fixed set's, so some best packing holds the fixed set. What no such set decides is packed by best fit,
longest first. Both work on counts per length, so their cost follows the window and not the documents. Pieces are
numbered within their length by counts per task and running sums: no length, however common, meets in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import strings, written
from lapse.llm.packing import byte_stand_ins, slots

WINDOW = 2048
# What a word-level file of this kind does to a text before merging, as its JSON says.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# The same for Latin characters, which no normal form changes and whose classes are the same in all versions of Unicode.
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t\\n\\r {_LETTERS}{_NUMBERS}]+")
_CHUNK = re.compile("[^\t\n\x0b\x0c\r ]+")
# Words whose ids a worker keeps, and the longest of them.
KNOWN_WORDS, KNOWN_LETTERS = 1 << 18, 32


def word_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray] | None:
    """(byte strings to merge ranks, ids of the ranks) of a byte-level BPE file with word ends; None for any other.

    A word's bytes are followed by a space, which stands for the end. Every byte first joins the space after it, then
    the file's merges follow in their order; single bytes come last, their rank is never looked at.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if (model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or file["normalizer"] != NORMALIZER
            or file["pre_tokenizer"] != SPLITTER or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")):
        return None
    stand_in = {c: b for b, c in byte_stand_ins().items()}

    def plain(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(stand_in[c] for c in (token[:-4] if end else token)) + b" " * end

    vocabulary, ranks, ids = model["vocab"], {}, []
    for name in [c + "</w>" for c in stand_in] + [m[0] + m[1] if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]] + list(stand_in):
        ranks[plain(name)] = len(ids)
        ids.append(vocabulary[name])
    return (ranks, np.array(ids, "<u4")) if len(ranks) == len(ids) else None


class WordEncoder:
    """Token ids of ``tokenizers`` without special tokens, as little-endian unsigned 32-bit bytes.

    For a file that ``word_ranks`` knows, Latin text is split here, and words are merged by rank and kept: the same ids in
    a fraction of the time. What stands between white space with other characters or an added token goes to the
    library, since no rule of such a file reaches over white space; other files go to it whole. A test holds both
    against each other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        found = word_ranks(path)
        self.merges = None
        if found:
            ranks, self.ids = found
            self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            last = np.zeros(len(self.ids), bool)
            last[[r for token, r in ranks.items() if token.endswith(b" ")]] = True
            self.last = last

    def __call__(self, text: str) -> bytes:
        if not self.merges:
            return self._library(text)
        added = [t for t in self.added if t in text]
        if not added and _PLAIN.fullmatch(text):
            return self._latin(text)
        out = []
        for latin, chunks in groupby(_CHUNK.findall(text), lambda c: not any(t in c for t in added) and _PLAIN.fullmatch(c) is not None):
            out.append((self._latin if latin else self._library)(" ".join(chunks)))
        return b"".join(out)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _latin(self, text: str) -> bytes:
        words = _WORD.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        fresh = [w for w in set(words) if w not in self.known]
        ranks = self.merges.encode_to_numpy(" ".join(fresh) + " ")
        ends = np.flatnonzero(self.last[ranks]) + 1
        ids, at = self.ids[ranks].tobytes(), [0, *(4 * ends).tolist()]
        merged = {w: ids[a:b] for w, a, b in zip(fresh, at, at[1:])}
        self.known.update(merged)
        found = b"".join(map(self.known.__getitem__, words))
        full = len(self.known) > KNOWN_WORDS
        for w in fresh if full else [w for w in fresh if len(w) > KNOWN_LETTERS]:
            del self.known[w]
        return found


_encoders: dict[str, WordEncoder] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, part, nth) of each text's ids and ``end_id``; ``nth`` counts the pieces
    of that length within the task ``part``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            row, nth_piece, start, length, crc, nth = ([] for _ in range(6))
            for i, text in enumerate(strings(batch.column(1))):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * window)):
                    piece = ids[at:at + 4 * window]
                    n = len(piece) // 4
                    row.append(i)
                    nth_piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(nth_piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc, [part] * len(row), nth)]],
                ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def _times(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often the set of lengths can be taken from the counts."""
    return min(int(left[n]) // k for n, k in Counter(lengths).items())


def dominating(left: np.ndarray, j: int, window: int) -> tuple[int, ...] | None:
    """A set with the length ``j`` that dominates all others with it, among the pieces counted in ``left``; None if none is
    known to.

    With room R beside ``j``, a set is dominated if its pieces can take the places of the dominating set's: alone where
    nothing fits; the longest fitting piece where it fills R, where no two pieces fit, or where no two that fit are
    longer together. Where no three fit, the longest fitting piece ``a`` with the longest ``b`` beside it dominates if
    every two that fit have the shorter at most ``b``, or are together at most ``a``.
    """
    rest = left.copy()
    rest[j] -= 1
    room = window - j
    fitting = np.flatnonzero(rest[:room + 1])
    if not len(fitting):
        return (j,)
    a = int(fitting[-1])
    if a == room:
        return j, a
    # The three shortest pieces, repeats included.
    short = np.repeat(fitting[:3], np.minimum(rest[fitting[:3]], 3))[:3]
    if len(short) < 2 or short[0] + short[1] > room:
        return j, a
    if len(short) == 3 and short.sum() <= room:
        return None
    # The longest partner of each fitting piece as the shorter of two, by its place in ``fitting``.
    partner = np.searchsorted(fitting, room - fitting, side="right") - 1
    longest = np.where(partner >= 0, fitting[partner], 0)
    twice = rest[fitting] > 1
    same = (longest == fitting) & ~twice
    longest = np.where(same, np.where(partner > 0, fitting[np.maximum(partner - 1, 0)], 0), longest)
    pair = longest >= fitting  # this piece is the shorter of two that fit
    total = np.where(pair, longest + fitting, 0)
    if total.max() <= a:
        return j, a
    rest[a] -= 1
    beside = np.flatnonzero(rest[:room - a + 1])
    if not len(beside):
        return None
    b = int(beside[-1])
    return (j, a, b) if total[fitting > b].max(initial=0) <= a else None


def reduce(histogram: np.ndarray, window: int) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """(fixed sets with their repeats, counts left): dominance is tried on every length, longest first, until none applies."""
    left = histogram.astype(np.int64).copy()
    fixed: list[tuple[list[int], int]] = []
    changed = True
    while changed:
        changed = False
        for j in range(window, 0, -1):
            while left[j]:
                found = dominating(left, j, window)
                if not found:
                    break
                # The same set goes on dominating while it can be taken: pieces only get fewer.
                times = _times(left, found)
                for n in found:
                    left[n] -= times
                fixed.append((list(found), times))
                changed = True
    return fixed, left


def best_fit(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Longest piece first, into the window with the least room that holds it; equal windows are counted, not listed."""
    windows: list[list[tuple[list[int], int]]] = [[] for _ in range(window + 1)]  # by room

    for n in range(window, 0, -1):
        h = int(left[n])
        if not h:
            continue
        # A window that got one piece has less room than it had, so it takes the next one as long as one fits.
        for room in [r for r in range(n, window + 1) if windows[r]]:
            k = room // n
            for row, times in windows[room][:]:
                if not h:
                    break
                windows[room].remove((row, times))
                full = min(times, h // k)
                h -= full * k
                if full:
                    windows[room - k * n].append((row + [n] * k, full))
                if full < times and h:
                    windows[room - h * n].append((row + [n] * h, 1))
                    full, h = full + 1, 0
                if full < times:
                    windows[room].append((row, times - full))
            if not h:
                break
        k = window // n
        if h // k:
            windows[window - k * n].append(([n] * k, h // k))
        if h % k:
            windows[window - h % k * n].append(([n] * (h % k), 1))
    return [w for room in windows for w in room]


def lower_bound(histogram: np.ndarray, window: int) -> int:
    """Martello and Toth's L2: no packing has fewer windows."""
    lengths = np.arange(window + 1)
    count = np.concatenate((np.cumsum(histogram[::-1])[::-1], [0]))  # pieces of a length or more
    tokens = np.concatenate((np.cumsum((histogram * lengths)[::-1])[::-1], [0]))
    best = -(-int(tokens[0]) // window)
    for least in range(window // 2 + 1):
        # Longer than window - least: alone. Up to half a window: no two of the rest share. The short ones fill what is left.
        high, half = window - least + 1, window // 2 + 1
        middle, short = int(count[half] - count[high]), int(tokens[least] - tokens[half])
        room = middle * window - int(tokens[half] - tokens[high])
        best = max(best, int(count[half]) + max(0, -(-(short - room) // window)))
    return best


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[list[int], int]], int]:
    """(lengths of a window's pieces and how many such windows; how many of the rows the reduction fixed)."""
    fixed, left = reduce(histogram, window)
    return fixed + best_fit(left, window), len(fixed)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, sequence_tokens, fixed) per piece.

    Every row of ``docs`` is packed, repeated rows and null ids too; a null or blank text has the end id alone; an empty
    table gives no pieces. A text of at most ``window`` ids is one piece, a longer one is cut at every ``window`` ids.
    ``fixed`` tells pieces in sets that dominance decided. Other columns are not read. To the driver comes one count per
    length. Runs of equal places go back to the tasks: of a window of W tokens at most 4 W kinds of windows, each
    with fewer than sqrt(2 W) different lengths, however many documents there are.
    """
    pieces = written(cut_pieces(docs, tokenizer, id_col, text_col, window, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    rows, decided = plan(histogram, window)
    runs = np.array(sorted(slots(rows)), np.int64).reshape(-1, 6)
    first = np.cumsum([0] + [k for _, k in rows])
    fill = np.array([sum(row) for row, _ in rows], np.int64)
    kind = np.searchsorted(first, runs[:, 3], side="right") - 1
    keys = runs[:, 0] << 40 | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            _, low, _, sequence, step, offset = runs[at].T
            nth = rank - low
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + nth // step), pa.array(offset + nth % step * length),
                 pa.array(fill[kind[at]]), pa.array(kind[at] < decided)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequence_tokens", "fixed"])

    # Tasks x lengths offsets grow with the documents: joined by sort, never broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(
        run, f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
             "sequence_tokens long, fixed boolean")
