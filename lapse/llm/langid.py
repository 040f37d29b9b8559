"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted by SGD in numpy.

The fit runs in one task, over a bounded sample of labelled rows; the driver holds the model only. Rejection is calibrated
on all labelled rows that the fit hasn't seen, scored in tasks and brought together as sums and ranks: a text must be as sure
of its language, and its subwords as usual in that language, as all but a stated share of those rows. The second catches
languages that were not learned: the softmax has to choose among the learned ones and may be sure of a wrong one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import dropped, mix, octets, written
from lapse.operators import rank_search as R

BUCKETS, DIMENSIONS = 1 << 15, 16
# Labelled rows per language that the model is fitted on, about; of all languages together at most TOTAL_ROWS. More
# languages than MAX_LANGUAGES are an error.
SAMPLE_ROWS, TOTAL_ROWS, MAX_LANGUAGES = 600, 20_000, 256
# Temperatures that calibration chooses from.
TEMPERATURES = np.geomspace(0.02, 20, 73)
# Share of the rows seen by calibration alone that either bar may reject.
ALPHA = 0.0005
# Bytes of texts that are scored at a time; a longer text is scored by itself.
BLOCK_BYTES = 1 << 18
_LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"

# Bytes after folding: letters and the bytes of longer characters stay, all else is one separator.
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subword_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of all runs of 2, 3 and 4 bytes, words with a separator on both sides."""
    buckets, docs = zip(*subword_runs(texts))
    return np.concatenate(buckets), np.concatenate(docs)


def subword_runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``subword_buckets``, for each length of runs, each in order of the texts."""
    data = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)].astype(np.uint64)
    first = np.cumsum([0] + [len(t) + 2 for t in texts])
    keep = np.concatenate(([True], (data[1:] != 0) | (data[:-1] != 0)))  # runs of separators become one
    # Every text keeps the separator it starts with.
    keep[first[:-1]] = True
    place = np.flatnonzero(keep)
    data = data[keep]
    doc = np.searchsorted(first, place, side="right") - 1
    out = []
    h = data
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(257) + data[n - 1:]
        whole = doc[: len(h)] == doc[n - 1:]
        # No run spans words: a separator is only first or last.
        for inner in range(1, n - 1):
            whole &= data[inner: len(h) + inner] != 0
        whole &= (data[: len(h)] != 0) | (data[n - 1:] != 0)
        out.append(((mix(h[whole] + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int64), doc[: len(h)][whole]))
    return out


@dataclass(frozen=True)
class LanguageModel:
    """``table``: embedding times output weights, a row of scores per bucket; a text's scores are their mean. ``usual``: log
    share of each bucket in a language; a text's mean has the language's mean ``centre`` and the variance
    ``spread`` + ``noise`` / subwords."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    usual: np.ndarray
    temperature: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None
    least_score: float = 0.0
    least_usual: float = -np.inf

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores per language, mean log share in the best one, subwords) of each text."""
        k = len(self.languages)
        both = np.concatenate((self.table, self.usual), axis=1)  # one row of both is one read
        sums, n = np.zeros((len(texts), 2 * k)), np.zeros(len(texts), np.int64)
        low = 0
        while low < len(texts):
            # Texts of about so many bytes at a time: a subword takes some hundred bytes on its way.
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= BLOCK_BYTES:
                size += len(texts[high])
                high += 1
            for bucket, doc in subword_runs(texts[low:high]):
                count = np.bincount(doc, minlength=high - low)
                some = np.flatnonzero(count)
                if len(some):
                    starts = (np.cumsum(count) - count)[some]
                    sums[low + some] += np.add.reduceat(both[bucket], starts, axis=0, dtype=np.float64)
                n[low:high] += count
            low = high
        mean = sums / np.maximum(1, n)[:, None]
        scores = mean[:, :k] + self.bias
        return scores, mean[np.arange(len(texts)), k + scores.argmax(axis=1)], n

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, its calibrated probability, whether it is rejected) of each text."""
        scores, usual, n = self.scores(texts)
        p = softmax(scores / self.temperature)
        best, sure = p.argmax(axis=1), p.max(axis=1)
        rejected = sure < self.least_score
        if self.centre is not None:
            rejected |= self.unusual(best, usual, n) < self.least_usual
        return best, sure, rejected

    def unusual(self, best: np.ndarray, usual: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations from the language's mean."""
        return (usual - self.centre[best]) / np.sqrt(self.spread[best] + self.noise[best] / np.maximum(1, n))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def language_counts(labelled: DataFrame, languages: int = MAX_LANGUAGES) -> dict[str, int]:
    """Rows of each language."""
    rows = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()
    if len(rows) > languages:
        raise ValueError(f"more than {languages} languages: a model has a column for each")
    return {r["lang"]: r["n"] for r in rows}


def samples(labelled: DataFrame, counts: dict[str, int], rows: int) -> tuple[DataFrame, DataFrame]:
    """About ``rows`` rows (text, lang) of each language to fit on, at most six in ten, and all others to calibrate on; chosen
    by the id's hash. Rows (id, text, lang) come in."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(4), F.col("id")), 12).cast("double") / float(1 << 52)
    rows = min(rows, TOTAL_ROWS // max(1, len(counts)))
    bars = {lang: min(rows / n, 0.6) for lang, n in counts.items()}
    bar = F.create_map(*[F.lit(x) for pair in bars.items() for x in pair]) if bars else F.lit(None).cast("map<string,double>")
    placed = labelled.select("text", "lang", (u < F.element_at(bar, F.col("lang"))).alias("fit"))
    return placed.where("fit").select("text", "lang"), placed.where("not fit").select("text", "lang")


def pieces_of(text: bytes, pieces: int) -> list[bytes]:
    """The text, and ``pieces`` runs of 1 to 40 words from anywhere in it, so that short texts are learned too."""
    words = text.split()
    draw = np.random.default_rng(np.frombuffer(text[:4096] or b"-", np.uint8).astype(np.int64).sum() + len(text))
    parts = [text]
    for _ in range(pieces if words else 0):
        size = int(np.exp(draw.uniform(0, np.log(40))))
        at = int(draw.integers(0, max(1, len(words) - size + 1)))
        parts.append(b" ".join(words[at:at + size]))
    return parts


def example_features(sample: DataFrame, pieces: int = 3) -> DataFrame:
    """(lang, bucket array, weight array) per example: each sampled text whole, and pieces of it. A text is one byte string at
    a time; an example has at most BUCKETS entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, buckets, weights = [], [], []
            for text, name in zip(octets(batch.column(0)), batch.column(1).to_pylist()):
                for part in pieces_of(text, pieces):
                    b, _ = subword_buckets([part])
                    if len(b):
                        u, n = np.unique(b, return_counts=True)
                        lang.append(name)
                        buckets.append(u.astype(np.int32))
                        weights.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(buckets, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))],
                ["lang", "buckets", "weights"])

    return sample.mapInArrow(run, "lang string, buckets array<int>, weights array<float>")


def fit(examples: pa.Table, epochs: int = 6, rate: float = 4.0, seed: int = 4) -> LanguageModel | None:
    """Minibatch SGD over the examples, in an order of their own; None without examples."""
    names = tuple(sorted(set(examples.column("lang").to_pylist())))
    if not names:
        return None
    # Rows come in any order: sorted by their content, so that a retried task fits the same model.
    label = np.array([names.index(x) for x in examples.column("lang").to_pylist()])
    chunk = examples.column("buckets").combine_chunks()
    offset = chunk.offsets.to_numpy().astype(np.int64)
    bucket = chunk.values.to_numpy()[offset[0]:offset[-1]].astype(np.int64)
    weight = examples.column("weights").combine_chunks()
    weight = weight.values.to_numpy()[weight.offsets[0].as_py():weight.offsets[-1].as_py()]
    offset = offset - offset[0]
    content = np.add.reduceat(bucket * (bucket % 977 + 1), offset[:-1]) if len(offset) > 1 else np.zeros(0)
    order_of = np.lexsort((np.diff(offset), content, label))
    draw = np.random.default_rng(seed)
    e = (draw.normal(size=(BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(names)), np.float32)
    b = np.zeros(len(names), np.float32)
    share = np.bincount(label, minlength=len(names))
    balance = (len(label) / (len(names) * np.maximum(1, share))).astype(np.float32)
    size = 32
    total, step = epochs * -(-len(label) // size), 0

    def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = offset[which + 1] - offset[which]
        at = np.repeat(offset[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return bucket[at], weight[at], np.concatenate(([0], np.cumsum(n)[:-1]))

    for _ in range(epochs):
        order = draw.permutation(order_of)
        for low in range(0, len(order), size):
            some = order[low:low + size]
            ids, share_of, starts = rows(some)
            mean = np.add.reduceat(e[ids] * share_of[:, None], starts, axis=0)
            wrong = softmax(mean @ w + b).astype(np.float32)
            wrong[np.arange(len(some)), label[some]] -= 1
            wrong *= (balance[label[some]] / len(some))[:, None]
            lr = rate * (1 - step / total)
            step += 1
            back = wrong @ w.T
            n = np.diff(np.concatenate((starts, [len(ids)])))
            w -= lr * (mean.T @ wrong)
            b -= lr * wrong.sum(axis=0)
            np.subtract.at(e, ids, lr * 8 * np.repeat(back, n, axis=0) * share_of[:, None])
    # Smoothed by one subword in a thousand, spread over all buckets.
    usual = np.zeros((BUCKETS, len(names)))
    np.add.at(usual, (bucket, np.repeat(label, np.diff(offset))), weight)
    usual = np.log(0.999 * usual / share + 0.001 / BUCKETS)
    return LanguageModel(names, (e @ w).astype(np.float32), b.astype(np.float64), usual.astype(np.float32))


def fitted(examples: DataFrame) -> LanguageModel | None:
    """``fit`` in one task: the sample is bounded, and only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        model = fit(pa.Table.from_batches(held)) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model) if model else None)], pa.binary())], ["model"])

    rows = examples.repartition(1).mapInArrow(run, "model binary").collect()
    return next((LanguageModel(**m) for m in (pickle.loads(r["model"]) for r in rows) if m), None)


def held_scores(model: LanguageModel, held: DataFrame, pieces: int = 3) -> DataFrame:
    """One row per text and piece of ``held`` (text, lang) in a language of the model: whether it is whole, the language found,
    its mean log share, its subwords, and the scores of whole ones; and one row per task with ``losses``: rows, then the sum
    of their log losses at each temperature."""
    kinds = [pa.bool_(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float64())]
    names = ["whole", "best", "usual", "n", "scores", "losses"]
    place = {name: i for i, name in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses = np.zeros(1 + len(TEMPERATURES))
        for batch in batches:
            label, parts, whole = [], [], []
            for text, name in zip(octets(batch.column(0)), batch.column(1).to_pylist()):
                some = [p for p in pieces_of(text, pieces) if _letters(p)] if name in place else []
                label += [place[name]] * len(some) if some else []
                whole += [i == 0 for i in range(len(some))]
                parts += some
            if not parts:
                continue
            scores, usual, n = model.scores(parts)
            raw = scores.astype(np.float32).astype(float)
            each = np.arange(len(label))
            losses += [len(label), *(-np.log(softmax(raw / t)[each, label] + 1e-12).sum() for t in TEMPERATURES)]
            shown = [row if w else None for row, w in zip(raw.astype(np.float32), whole)]
            columns = [whole, raw.argmax(axis=1), usual, np.maximum(1, n), shown, [None] * len(label)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip([None] * 5 + [losses.tolist()], kinds)], names)

    return held.mapInArrow(run, "whole boolean, best int, usual double, n long, scores array<float>, losses array<double>")


def calibrated(model: LanguageModel, held: DataFrame, alpha: float = ALPHA, pieces: int = 3) -> LanguageModel:
    """The model with its temperature and bars, from rows (text, lang) it wasn't fitted on; as it is if there are none.

    The temperature is the one with the least log loss. The score bar is the ``alpha`` quantile over whole texts. The mean
    log share of a language's rows has a centre, a variance between texts and one that falls with the subwords, by least
    squares over whole texts and pieces; the other bar is the ``alpha`` quantile of the standardised values of all. Rows stay
    in tasks: sums per language and ranks come to the driver.
    """
    table = written(held_scores(model, held, pieces), "calibration")
    try:
        sums = table.where("losses is not null").select(F.posexplode("losses").alias("i", "loss"))
        losses = np.array([r["loss"] for r in sums.groupBy("i").agg(F.sum("loss").alias("loss")).orderBy("i").collect()])
        if not losses.any():
            return model
        rows = table.where("losses is null").drop("losses")
        temperature = float(TEMPERATURES[losses[1:].argmin()])
        k = len(model.languages)
        about = rows.agg(F.avg("usual"), F.var_pop("usual")).first()
        centre, spread, noise = np.full(k, about[0]), np.full(k, about[1] + 1e-9), np.zeros(k)
        sizes = {r["best"]: r["rows"] for r in rows.groupBy("best").agg(F.count("*").alias("rows")).collect()}
        several = sorted(i for i, size in sizes.items() if size > 1)
        middle = R.quantiles_of(rows.select(F.col("best").alias("series"), F.col("usual").alias("v")), [0.5], sizes)
        for i in several:
            centre[i] = middle[i][0]
        own = rows.where(F.col("best").isin(several)).select(
            "best", ((F.col("usual") - _of_language(centre)) ** 2).alias("square"), (1 / F.col("n")).alias("part"))
        caps = np.zeros(k)
        for r in own.groupBy("best").agg(F.avg("square").alias("mean")).collect():
            caps[r["best"]] = 9 * r["mean"]
        square, part = F.least("square", _of_language(caps)), F.col("part")
        for r in own.groupBy("best").agg(
                F.count("*").cast("double").alias("rows"), F.sum(part).alias("x"), F.sum(part * part).alias("xx"),
                F.sum(square).alias("y"), F.sum(part * square).alias("xy")).collect():
            line = np.linalg.lstsq([[r["rows"], r["x"]], [r["x"], r["xx"]]], [r["y"], r["xy"]], rcond=None)[0]
            spread[r["best"]], noise[r["best"]] = np.maximum(line, [1e-4, 0])
        out = replace(model, temperature=temperature, centre=centre, spread=spread, noise=noise)
        found = R.find_ranks(_sure_and_far(out, rows), lambda counts: {s: [int(alpha * n)] for s, n in counts.items()})
        bars = [next(iter(found[s].values())) if s in found else -np.inf for s in range(2)]
        return replace(out, least_score=bars[0], least_usual=bars[1])
    finally:
        dropped(table)


def _of_language(values: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("best") + 1)


def _sure_and_far(model: LanguageModel, rows: DataFrame) -> DataFrame:
    """(series, v): 0 and the probability of a whole text's language, 1 and how usual a text's or piece's subwords are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, usual, n = (batch.column(i).to_numpy() for i in range(3))
            scores = batch.column(3).drop_null()
            far = model.unusual(best, usual, n)
            sure = np.zeros(0)
            if len(scores):
                raw = scores.flatten().to_numpy().astype(float).reshape(len(scores), -1)
                sure = softmax(raw / model.temperature).max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(2), [len(sure), len(far)]).astype(np.int32)), pa.array(np.concatenate((sure, far)))], ["series", "v"])

    return rows.select("best", "usual", "n", "scores").mapInArrow(run, "series int, v double")


def train(
    docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> LanguageModel | None:
    """Model of the labelled rows for which ``learn_from`` holds; None if there are none."""
    labelled = docs.where(F.coalesce(learn_from, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    fit_on, check_on = samples(labelled, language_counts(labelled), rows)
    model = fitted(example_features(fit_on))
    return calibrated(model, check_on) if model else None


def _letters(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def judge(model: LanguageModel | None) -> Callable[[Column], Column]:
    """Column function: text -> struct(lang_pred, score, rejected), as in ``predict``."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(column: pa.Array) -> pa.Array:
        texts = octets(column)
        some = np.array([_letters(t) for t in texts], bool)
        names, sure, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if model and some.any():
            best, sure, rejected = model.judged(texts)
            sure = np.where(some, sure, 0.0)
            names = [model.languages[i] if s else UNDETERMINED for i, s in zip(best, some)]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(sure), pa.array(~some | rejected)], ["lang_pred", "score", "rejected"])

    return judged


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) per row, from the whole text alone.

    ``score`` is the calibrated probability of the language; a text that is null or has no letter is ``und`` with
    score 0. Rejected are those, texts less sure of their language and texts with subwords less usual in it than all but a
    share ``ALPHA`` each of the rows of calibration. Without a model every text is ``und`` and rejected. Repeated rows stay;
    texts of any length are whole. Other columns are not read.
    """
    return docs.select(F.col(id_col).alias("id"), judge(model)(F.col(text_col)).alias("j")).select("id", "j.*")


def held_out(id_col: str = "doc_id") -> Column:
    """One row in three, by the checksum of the id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
