"""Session settings every job relies on, and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# UTC keeps instants equal across engines; AQE coalesces and splits shuffle partitions at run time,
# so the initial number can be generous on a cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "lapse", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; extra ``conf`` entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine session that names none
    gets a temporary folder; a cluster session without the setting gets None.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        return None
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_DIRS[context.applicationId]


def shared_dir(spark: SparkSession) -> str:
    """As ``checkpoint_dir``; a cluster session without the setting is an error, not a local folder."""
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; the frame itself where there is none.

    Iterative fits run hundreds of jobs over the same rows. Cut here, each job ships a short plan
    instead of the whole feature build, and a lost executor re-reads files instead of replaying it.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not folder:
        return df
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def materialise(df):
    """Compute a frame once for several readers: checkpoint where possible, else a disk-backed cache."""
    return cut_lineage(df) if checkpoint_dir(df.sparkSession) else df.persist()


# Rows one task of an iterative fit should have at least.
FIT_ROWS = 20_000


def fit_ready(df, rows: int):
    """Lineage cut, merged into partitions worth a task, and cached: input for iterative fits.

    Every iteration is a job, so a small matrix spread over many partitions pays for scheduling only.
    Merging never adds partitions, so a large matrix keeps its own.
    """
    return cut_lineage(df).coalesce(max(1, -(-rows // FIT_ROWS))).cache()


def merged(df, rows: int):
    """A cached frame of ``rows`` rows read by tasks worth starting: as many as the cluster runs at once, more where a task would
    have over ``SHUFFLE_ROWS``. The cache keeps the partitions of the shuffle that made it, and every aggregate over it would
    start a task and open a file per output partition for each. Merging never adds partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHUFFLE_ROWS)))


# Rows that one task of a shuffled aggregate should have at most, the bytes AQE merges small partitions to, and the bytes of a
# file that one task reads and aggregates before the shuffle.
SHUFFLE_ROWS, SHUFFLE_BYTES, SCAN_BYTES = 250_000, "8m", "32m"


def spread_shuffles(spark: SparkSession, rows: int) -> int:
    """Shuffles of ``rows`` rows get partitions in proportion, so that a task's memory doesn't grow with the input.

    A fixed ``spark.sql.shuffle.partitions`` lets it grow. AQE merges partitions that turn out small; the smaller bytes keep it
    from merging millions of narrow rows into one task. Returns the number of partitions.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-rows // SHUFFLE_ROWS))
    if n > least:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", n)
    else:
        # Without it the number follows spark.sql.shuffle.partitions, also when that is changed later.
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    return n
