"""Quality rules with host verdicts. DataFrame functions only.

Every document is judged by base rules; failures are counted per host, each host's failure rate is shrunk
towards all hosts by an empirical beta prior, and a host whose shrunken rate is too high loses its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import blank, written

WINDOW = 5
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row; a null text counts as empty.

    Repeated word windows are found by sorting a text's window hashes together with their places: n log n in its
    words, inside one row.
    """
    text = blank(F.col("_text"))
    plain = F.translate(text, SPACES, " " * len(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    rows = rows.select(
        "_id", "_host",
        (F.length(text) - _count(text, SPACES)).alias("word_chars"), _count(text, SYMBOLS).alias("n_symbols"),
        F.filter(F.split(plain, " "), lambda w: w != "").alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    windows = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    rows = rows.select(
        "_id", "_host", "word_chars", "n_symbols", n.alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(n >= WINDOW, windows).alias("_hashes"))
    # Most texts repeat no window: a hash set tells, and only the others sort.
    repeated = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    rows = rows.select("*", F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("_sorted"))
    def same(x: Column, other: Column) -> Column:
        return F.coalesce(other["h"] == x["h"], F.lit(False))

    twice = F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i - 1)) | same(x, F.get("_sorted", i + 1)))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda x: x["at"])).alias("_at"))
    pairs = F.greatest(F.size("_at") - 1, F.lit(0))
    steps = F.zip_with(F.slice("_at", F.lit(2), pairs), F.slice("_at", F.lit(1), pairs), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("_at") > 0, F.aggregate(steps, F.lit(0), lambda s, x: s + x) + WINDOW).otherwise(0)
    return rows.select(
        F.col("_id").alias("id"), F.col("_host").alias("host"),
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        F.when(F.col("_at").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 10, max_repeat_pct: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def host_verdicts(judged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """(host, host_docs, host_rate, host_ok) from rows (host, base_failed); a null host is a host of its own.

    Beta prior by moments of the raw rates of all hosts, weighted by their rows: mean m and variance v give the
    strength s = m (1 - m) / v - 1, kept within [1, 1000]; without spread or with one host it is 1000. The shrunken rate
    is (failures + m s) / (rows + s); a host is right while it is at most ``max_rate``. The prior is a one-row
    aggregate of one row per host.
    """
    hosts = judged.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    total = F.col("t.docs")
    sums = hosts.agg(
        F.sum("host_docs").cast("double").alias("docs"), F.sum("host_failed").cast("double").alias("failed"),
        F.sum(F.col("host_failed").cast("double") * F.col("host_failed") / F.col("host_docs")).alias("squares"))
    m = F.col("t.failed") / total
    v = F.greatest(F.col("t.squares") / total - m * m, F.lit(0.0))
    s = F.when(v > m * (1 - m) / 1001, F.greatest(F.try_divide(m * (1 - m), v) - 1, F.lit(1.0))).otherwise(1000.0)
    priors = sums.alias("t").where("docs > 0").select(m.alias("mean"), s.alias("strength"))
    # One row, by construction.
    both = hosts.crossJoin(F.broadcast(priors))
    rate = (F.col("host_failed") + F.col("mean") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    return both.select("host", "host_docs", rate.alias("host_rate"), (rate <= max_rate).alias("host_ok"))


def host_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5,
) -> DataFrame:
    """Counts, base verdict, host verdict and ``kept`` per row of ``docs``; only counts are shuffled, never texts.

    Repeated rows are judged and counted each; null ids stay null. Other columns are not read.
    """
    # Written once: verdicts and rows both read the narrow counts, and no text is counted twice.
    judged = written(text_counts(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()), "counts")
    hosts = host_verdicts(judged.select("host", "base_failed"), max_rate)
    return (judged.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
            .select("d.*", "h.host_docs", "h.host_rate", "h.host_ok",
                    (~F.col("d.base_failed") & F.coalesce("h.host_ok", F.lit(True))).alias("kept")))
