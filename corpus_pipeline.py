"""The corpus pipeline: five stages, each over all that the one before kept.

    language    documents whose language is not recognised go
    near_dups   one document of each group of similar texts stays
    benchmark   documents that hold a benchmark item go
    personal    personal data in texts is replaced by its kind
    pack        the token ids of the rest, packed into windows
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import decontaminate, langid, packing, pii, simhash
from lapse.llm.common import blank, shared_folder, small_batches, table, written
from lapse.llm.queries import TOKENIZER


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): whole rows as structs, so that no column of ``docs`` clashes with ours; keys are (doc_id, node), the node a
    hash of the text."""
    return docs.select(
        F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(blank(F.col("text"))).alias("node")).alias("key"), F.struct("*").alias("row"))


def _rows(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: no letter (a null or empty text too), or by its calibrated bars.

    The model is learned from the labelled rows of ``docs``; without any, all go. Repeated rows are judged alike, columns
    but doc_id, text and lang are not read, an empty table stays empty.
    """
    small_batches(spark)
    judge = langid.judge(langid.train(docs, F.col("doc_id").isNotNull()))
    return docs.where(~judge(F.col("text"))["rejected"])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar texts (five-word shingles, Jaccard 0.8) the row with the smallest id; among equal
    ids the text with the smallest hash, and of equal rows one. Null ids come last; null and wordless texts are one group.
    Other columns are kept whatever their names; an empty table stays empty."""
    small_batches(spark)
    keyed = _keyed(docs)
    groups = simhash.similar_groups(docs).withColumnRenamed("node", "member")
    # Equal texts are one node: their first row, then the group's.
    nodes = keyed.select("key.*").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = (nodes.join(groups, nodes.node == groups.member, "left")
              .select("node", "first", F.coalesce("root", "node").alias("root")))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    kept = (placed.join(best, "root").where(F.col("first").eqNullSafe(F.col("best")))
            .groupBy("root").agg(F.min("node").alias("node"), F.first("first").alias("first"))
            .select(F.struct(F.col("first").alias("doc_id"), "node").alias("kept")))
    # Rows that are equal in id and text are the same document: a count of the keys tells where there are any.
    rows = keyed.groupBy(F.col("key").alias("equal")).agg(F.count("*").alias("rows"))
    kept = written(kept.join(rows, F.col("kept").eqNullSafe(F.col("equal"))).select("kept", (F.col("rows") > 1).alias("twice")), "kept")
    # Columns by number, not as one struct: so both branches read one shuffle of the texts.
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = keyed.select("key", *[F.col("row").getField(c).alias(name) for c, name in zip(docs.columns, names)])
    marked = flat.join(kept, F.col("key").eqNullSafe(F.col("kept")))
    single, several = marked.where("not twice"), marked.where("twice").select("key", *names).dropDuplicates(["key"])
    return single.select(names).unionByName(several.select(names)).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark is found; rows are told apart by id and text, so repeated rows go
    together. Null and wordless texts stay; other columns are kept whatever their names."""
    small_batches(spark)
    keyed = _keyed(docs)
    texts = keyed.select("key", F.col("row").getField("text").alias("text"))
    found = decontaminate.leaks(texts, table(spark, sf_dir, "benchmark"), id_col="key")
    leaked = found.select(F.col("id").alias("leaked")).distinct()
    return _rows(keyed.join(leaked, F.col("key").eqNullSafe(F.col("leaked")), "left_anti"), docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts; every document stays, repeated rows too, and n_chars follows the text. A null text
    stays null; other columns are as they are."""
    small_batches(spark)
    redacted = docs.withColumn("text", pii.redactor(pii.fit(pii.scan(docs, "doc_id", "text")))(F.col("text")))
    if "n_chars" not in docs.columns:
        return redacted
    kind = dict(docs.dtypes)["n_chars"]
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids; a null or empty text is its end id, repeated rows are packed each,
    an empty table gives no pieces, other columns are not read."""
    small_batches(spark)
    return packing.pack(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_dups", near_dups), ("benchmark", benchmark), ("personal", personal), ("pack", pack)]

# SQL expresses neither the fitted models nor the tokenizer: the stages are held against plain versions in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return docs
