"""Exact deduplication of lines or paragraphs over a whole corpus.

Units are normalised and digested in place; the first occurrence of a digest, by rank, stays everywhere, all others
go. Digests are counted before the shuffle; only units whose digest occurs twice are joined back. What is joined are
written tables: a line that very many documents hold is one large partition on one side, which Spark splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import blank, strings, written

# How texts fall into units.
SEPARATORS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r]*\n\\s*")}
_TRIM = re.compile("[^\\W_]+")


def normalised(unit: str) -> str:
    """Lower case, runs of letters and digits only: case, spacing and punctuation don't tell units apart."""
    return " ".join(_TRIM.findall(unit.lower()))


def units(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """(id, node, start, end, words, hi, lo): hash of the text, code-point offsets, normalised words and the 128-bit digest of
    units of ``min_words`` or more."""
    split = SEPARATORS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, end, words, digests = [], [], [], [], []
            for row, text in enumerate(strings(batch.column(2))):
                at = 0
                for stop, after in [m.span() for m in split.finditer(text)] + [(len(text), len(text))]:
                    plain = normalised(text[at:stop])
                    n = plain.count(" ") + 1
                    if n >= min_words and plain:
                        ids.append(row)
                        start.append(at)
                        end.append(stop)
                        words.append(n)
                        digests.append(xxhash.xxh3_128_digest(plain.encode()))
                    at = after
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(x, pa.int64()) for x in (start, end, words)],
                 pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["id", "node", "start", "end", "words", "hi", "lo"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), _node(text_col).alias("node"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, node long, start long, end long, words long, hi long, lo long")


def _node(text_col: str) -> Column:
    """Rows of equal id and different texts are different documents."""
    return F.xxhash64(blank(F.col(text_col)))


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 8,
) -> DataFrame:
    """The units to remove: (id, node, start, end, words, first_id, first_start, copies), offsets in code points of the text;
    ``node`` is the xxhash64 of the text, null as empty.

    The rank of an occurrence is (id, start, node), smallest first; null ids rank last. Units of fewer than ``min_words``
    normalised words are left alone, they repeat by chance. Repeated rows (equal id and text) hold the same
    occurrence: the unit is kept in each of them. A null text has no units. Other columns are not read.
    """
    found = written(units(docs, id_col, text_col, unit, min_words), "units")
    copies = written(found.groupBy("hi", "lo").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    rank = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), "start", "node")
    known = written(found.join(copies, ["hi", "lo"]).withColumn("rank", rank), "repeated")
    firsts = written(known.groupBy("hi", "lo").agg(F.min("rank").alias("first")), "firsts")
    return known.join(firsts, ["hi", "lo"]).where(F.col("rank") != F.col("first")).select(
        "id", "node", "start", "end", "words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), "copies")


def _spanned(docs: DataFrame, removed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, with its removed spans (start, end, words) in order; null for none."""
    spans = removed.groupBy("id", "node").agg(F.sort_array(F.collect_set(F.struct("start", "end", "words"))).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), _node(text_col).alias("node")).alias("key"))
    spans = spans.select(F.struct("id", "node").alias("of"), "spans")
    return rows.join(spans, F.col("key").eqNullSafe(F.col("of")), "left").select("row", "spans")


def _left(text: Column) -> Column:
    """The text without the spans, each with the line feed after it."""
    def before(i: Column) -> Column:
        return F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("spans", i - 1)["end"] + 1)

    gaps = F.transform("spans", lambda s, i: F.substr(
        text, (before(i) + 1).cast("int"), F.greatest(s["start"] - before(i), F.lit(0)).cast("int")))
    tail = F.substr(text, (F.element_at("spans", -1)["end"] + 2).cast("int"))
    return F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(gaps, ""), tail))


def without_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of the text; all columns as they are, a null text stays null."""
    text = F.col("row").getField(text_col)
    return _spanned(docs, removed, id_col, text_col).select(
        *[(_left(text) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


# A removed stretch of more words than this is a passage.
PASSAGE_WORDS = 50


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 8) -> DataFrame:
    """(id, n_lines, n_removed, n_passages, removed, n_chars, text) per row of ``docs``, every one of them.

    ``removed`` lists the cut spans as (start, end, words) in code points of the whole text, ``n_passages`` counts
    stretches of adjoining removed units with over ``PASSAGE_WORDS`` words together, ``text`` is what is left. A null text
    counts as empty, with one empty line. Otherwise as ``repeated_units``.
    """
    text = blank(F.col("row").getField(text_col))
    rows = _spanned(docs, repeated_units(docs, id_col, text_col, unit, min_words), id_col, text_col)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,end:long,words:long>>"))
    # Words so far of the stretch that each span is in: it goes on where a span starts right after the one before.
    run = F.aggregate("removed", F.struct(F.lit(-2).cast("long").alias("end"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("n")),
                      lambda a, s: F.struct(
                          s["end"].alias("end"),
                          (F.when(s["start"] == a["end"] + 1, a["words"]).otherwise(0) + s["words"]).alias("words"),
                          (a["n"] + F.when((F.when(s["start"] == a["end"] + 1, a["words"]).otherwise(0) + s["words"] > PASSAGE_WORDS)
                                           & ((s["start"] != a["end"] + 1) | (a["words"] <= PASSAGE_WORDS)), 1).otherwise(0)).alias("n")))
    return rows.select(
        F.col("row").getField(id_col).alias("id"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        spans.alias("removed"), _left(text).alias("text")).select(
        "id", "n_lines", F.size("removed").cast("long").alias("n_removed"), run["n"].alias("n_passages"), "removed",
        F.length("text").cast("long").alias("n_chars"), "text")
