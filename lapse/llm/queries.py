"""One query per operator, over whole tables, with production parameters; and the SQL texts of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import (
    chat, decontaminate, dom, dominance, host_rules, langid, lines, orchard, packing, pii, resample, simhash, variants)
from lapse.llm.common import small_batches, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048."""
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op3_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled for likeness to the good, harmless ones; as many as their share among the labelled."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    labels = table(spark, sf_dir, "labels")
    sample = resample.resample(
        table(spark, sf_dir, "documents"), labels.where(good).select("doc_id"), resample.target_share(labels, good))
    return sample.withColumnRenamed("id", "doc_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, base verdict and verdict of the host, the document's source."""
    judged = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.personal_spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *map(count, pii.BASE_KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has: removed spans, and size and digest of what is left."""
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_passages", F.array_join(spans, ",").alias("removed"), "n_chars",
        F.sha2("text", 256).alias("left_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    keyed = pages.select(F.struct("page_id", "url").alias("key"), "html")
    found = dom.extract(keyed, dom.fit(pages), "key", "html")
    return found.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered conversations, read back: digests of turns and of the text under the loss mask."""
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rendered = chat.formatted_conversations(turns.unionByName(more))
    read = rendered.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                           F.array_join(chat.masked(F.col("formatted"), F.col("mask")), "").alias("loss"))
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(log, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector in four codebooks, the error of each code and of each label."""
    coded, books = orchard.compress(table(spark, sf_dir, "embeddings"))
    return orchard.label_errors(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(orchard.digest(books)).alias("codebooks_sha256"))


def op12_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in as few sequences of at most 2048 ids as found."""
    packed = dominance.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return packed.withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' count, its form and its root."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def _corpus_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = {
    f.__name__: f for f in (
        op1_packing, op2_decontamination, op3_quality_sample, op4_language, op5_host_rules, op6_personal_data, op7_line_dedup,
        op8_main_text, op9_near_duplicates, op10_chat, op11_orchard, op12_dominance_packing, op13_spelling_variants)
} | {"pipeline": _corpus_pipeline}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return build(spark, sf_dir)

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        return run

    return {name: bounded(build) for name, build in _QUERIES.items()}


# The white space that separates words, in DuckDB's regular expressions.
_WORD = r"[^ \t\n\x0b\x0c\r]+"

SQL = {
    "op5_host_rules": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT k, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT k, regexp_extract_all(text, '{_WORD}') AS w FROM docs)),
windows AS (
  SELECT k, i, lead(word, 4) OVER v AS last,
    concat_ws(' ', word, lead(word) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v) AS w
  FROM words WINDOW v AS (PARTITION BY k ORDER BY i)),
twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT k, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(5)) AS d) GROUP BY k),
lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}') GROUP BY k),
counts AS (
  SELECT d.k, d.doc_id, d.source, len(regexp_extract_all(text, '{_WORD}')) AS n_words,
    length(regexp_replace(text, '[ \t\n\x0b\x0c\r]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN lines l USING (k) LEFT JOIN covered c USING (k)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source),
moments AS (
  SELECT sum(f) / sum(n) AS m, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ^ 2, 0) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > m * (1 - m) / 1001 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 1000 END AS s FROM moments),
verdicts AS (
  SELECT source, (f + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept, round(rate, 9) AS host_rate
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source""",
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line, len(a) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
placed AS (
  SELECT doc_id, line, i, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines),
units AS (
  SELECT *, start + length(line) AS "end",
    array_to_string(regexp_extract_all(lower(line), '[\p{L}\p{N}\p{M}]+'), ' ') AS unit FROM placed),
long AS (SELECT doc_id, i, unit, start, len(string_split(unit, ' ')) AS words FROM units WHERE len(string_split(unit, ' ')) >= 8),
ranked AS (
  SELECT doc_id, i, words, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start) > 1 AS gone FROM long),
marked AS (
  SELECT u.*, coalesce(r.gone, false) AS gone, coalesce(r.words, 0) AS words FROM units u LEFT JOIN ranked r USING (doc_id, i)),
stretches AS (
  SELECT doc_id, sum(words) AS words FROM (
    SELECT doc_id, gone, words, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS stretch FROM marked)
  WHERE gone GROUP BY doc_id, stretch),
passages AS (SELECT doc_id, count(*) AS n FROM stretches WHERE words > 50 GROUP BY doc_id),
cut AS (
  SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
    coalesce(string_agg(start || ':' || "end", ',' ORDER BY start) FILTER (gone), '') AS removed,
    coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY start) FILTER (NOT gone), '') AS remaining
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(p.n, 0)::BIGINT AS n_passages, removed, length(remaining)::BIGINT AS n_chars,
  sha256(remaining) AS left_sha256
FROM cut LEFT JOIN passages p USING (doc_id)""",
    "op10_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#'), ': ', ':\ ') AS head FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""",
}


def _orchard_sql(rounds: int = 4) -> str:
    """Nearest entries by trying all of them, round after round."""
    def assigned(book: str) -> str:
        return f"""SELECT vec_id, label, part, v, min(d * 256 + entry) AS best FROM (
    SELECT p.vec_id, p.label, p.part, p.v, b.entry,
      list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN {book} b ON p.part = b.part) GROUP BY ALL"""

    steps = "".join(f"""
a{r} AS ({assigned(f"b{r}")}),
m{r} AS (
  SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
    SELECT part, best % 256 AS entry, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL)
  GROUP BY ALL),
b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry)),""" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, part, v[part * 16 + 1 : part * 16 + 16] AS v FROM kept, (SELECT unnest(range(4)) AS part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),{steps}
final AS ({assigned(f"b{rounds}")}),
codes AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM final GROUP BY vec_id, label),
totals AS (SELECT label, sum(error)::BIGINT AS label_error FROM codes GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM codes c JOIN totals t ON c.label IS NOT DISTINCT FROM t.label, books"""


def _variants_sql() -> str:
    """Near words meet by the text left without one letter; checksums go byte by byte through their table."""
    step = "c"
    for _ in range(8):
        step = f"list_transform({step}, lambda c: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    step = step.replace("list_transform(c,", "list_transform(range(256),")
    letters = "A-Za-zÀ-ÿ"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE crc_table AS (SELECT {step} AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{letters}]+')), '{upper}', '{lower}') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195, unicode(ch)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc_table),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM short a JOIN short b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM short a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM short a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, max(m) AS m FROM near GROUP BY word, n),
forms AS (
  SELECT b.word, min(x.other) AS form, b.m AS form_n FROM best b JOIN near x ON x.word = b.word AND x.m = b.m WHERE b.m >= 5 * b.n GROUP BY ALL),
chain AS (
  SELECT word, word AS root FROM words
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w JOIN roots r USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)"""


SQL |= {"op11_orchard": _orchard_sql(), "op13_spelling_variants": _variants_sql()}


def sql_texts() -> dict[str, str]:
    return dict(SQL)
