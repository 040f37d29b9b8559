"""Importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample by their ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import mix, octets, word_hashes, written

BUCKETS = 1 << 16
# Labelled target rows that the target model is fitted on, at most: a bound on what is broadcast.
TARGET_ROWS = 20_000


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of every word and every pair of neighbouring words of a text."""
    h, doc = word_hashes([t.lower() for t in texts])
    near = doc[1:] == doc[:-1]
    two = mix(h[:-1] * np.uint64(3) + h[1:])[near]
    mask = np.uint64(BUCKETS - 1)
    return (np.concatenate((h & mask, two & mask)).astype(np.int64), np.concatenate((doc, doc[1:][near])))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) over rows (text, chosen): one dense vector per task, summed per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            bucket, doc = gram_buckets(octets(batch.column(0)))
            chosen = np.array(batch.column(1).fill_null(False).to_pylist(), bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            if chosen.any():
                target += np.bincount(bucket[chosen[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability per bucket; the raw counts are scaled to the target's size before both are
    smoothed, so that a bucket the target has hardly any chance to hold tells nothing. Zeros without target rows."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():  # BUCKETS rows at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + smoothing) - np.log(raw * (target.sum() / raw.sum()) + smoothing)


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """(id, n_grams, log_weight, key) from rows (id, text). ``key`` adds Gumbel noise drawn from the id's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, doc = gram_buckets(octets(batch.column(1)))
            n = np.bincount(doc, minlength=len(batch))
            w = np.bincount(doc, ratio[bucket], len(batch)).astype(float)  # whole numbers if there are no words
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(w), batch.column(2)], ["id", "n_grams", "log_weight", "u"])

    kind = dict(docs.dtypes)["id"]
    # 52 bits of the hash, as a number strictly between 0 and 1.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 12).cast("double") + 0.5) / float(1 << 52)
    return docs.select("id", "text", u.alias("u")).mapInArrow(
        run, f"id {kind}, n_grams long, log_weight double, u double").select(
        "id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("key"))


def top_k(keyed: DataFrame, k: int, steps: int = 12, bins: int = 1024) -> DataFrame:
    """Rows of the ``k`` largest ``key`` values; all rows that tie with the last stay.

    The threshold is found by counting per equal-width bin and narrowing to the bin that holds it: each step is one
    aggregate of ``bins`` rows at most, nothing is sorted or gathered.
    """
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return keyed.where(F.lit(k > 0))
    above = 0  # rows over the interval [low, high]
    for _ in range(steps):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        found = keyed.where(F.col("key").between(low, high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for row in sorted(found, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        else:
            return keyed  # k is all rows or more
        if above + row["n"] == k:
            break
    return keyed.where(F.col("key") >= low)


def resample(
    docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 0,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """The sample, (id, n_grams, log_weight, key): ``share`` of all rows, drawn without replacement in proportion to
    exp(log_weight).

    ``target_ids`` has one column of ids of target rows; the target model takes the ``target_rows`` of them with the
    smallest hash, the raw model and the weights take all rows. Null ids are never targets; a null text has no n-grams
    and weight 0. Repeated rows are rows each, with the same noise, so they tie. Other columns are not read. An empty
    table gives an empty sample; without targets all weights are 0 and the sample is uniform.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = F.col(target_ids.columns[0])
    chosen = (target_ids.select(key.alias("target")).where("target is not null").distinct()
              .orderBy(F.xxhash64("target"), "target").limit(target_rows))
    marked = rows.join(F.broadcast(chosen), rows.id == chosen.target, "left").select(
        "text", F.col("target").isNotNull().alias("chosen"))
    ratio = log_ratio(bucket_counts(marked))
    keyed = written(weights(rows, ratio, seed), "weights")
    return top_k(keyed, round(share * keyed.count()))


def target_share(labels: DataFrame, is_target) -> float:
    """Share of target rows among the labelled ones, 1 without labels: the default size of the sample."""
    row = labels.agg(F.avg(F.coalesce(is_target, F.lit(False)).cast("double"))).first()
    return 1.0 if row[0] is None else float(row[0])
