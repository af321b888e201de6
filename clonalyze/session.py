"""Spark session helpers.

The library never creates its own cluster settings beyond what a local test run
needs: on a cluster the session is handed in by the caller, and the shared
checkpoint folder comes from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPREAD_ROWS = 2000      # fewer rows aren't worth a shuffle
TASK_VALUES = 1 << 20   # numbers of a table that a task of an iterative fit goes through, at least


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "clonalyze") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, bench) gets a fresh
    scratch folder; a cluster session without it is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        local = current.startswith("/") or (current.startswith("file:") and "/tmp/clonalyze-ckpt-" in current)
        if local and not sc.master.startswith("local"):
            raise RuntimeError(f"checkpoint folder {current} is on one machine; set spark.checkpoint.dir to a shared folder")
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running clonalyze jobs")
    path = tempfile.mkdtemp(prefix="clonalyze-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    A lost executor replays nothing before it. Unlike ``checkpoint()``, which computes its input a second time
    to write it, the table is computed once, and its size is known to the joins that follow.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as the session runs at once, dealt by ``keys`` where its files hold too few row groups.

    A Parquet file is read by one task a row group, and a file of several GB may have a single one. Rows are counted
    by task from the files' footers.
    """
    n, busy = df.select(F.spark_partition_id().alias("p")).agg(F.count("p"), F.count_distinct("p")).first()
    if n < SPREAD_ROWS or busy >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(*keys)


def gathered(df: DataFrame, width: int) -> DataFrame:
    """``df``, kept, in no more partitions than its rows of ``width`` numbers ask for (``TASK_VALUES`` a task).

    A fit starts a job an iteration: over a small table its time is that of starting tasks. A large one keeps its partitions.
    """
    kept = materialize(df)
    parts = max(1, -(-kept.count() * max(width, 1) // TASK_VALUES))
    if parts >= kept.rdd.getNumPartitions():
        return kept
    few = materialize(kept.coalesce(parts))
    few.count()
    release(kept)
    return few


def release(*dfs: DataFrame) -> None:
    """Let go of what ``materialize`` kept, once a job's results are written."""
    for df in dfs:
        df.unpersist()


def materialize(df: DataFrame) -> DataFrame:
    """Keep a derived table that feeds several branches of one job (e.g. a model
    fitted on the same rows it then scores) instead of deriving it twice.

    Memory-and-disk persistence: a lost executor's blocks are recomputed from
    lineage, so this is safe where ``localCheckpoint`` would not be.
    """
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def size_for_input(spark: SparkSession, input_bytes: int, target_bytes: int = 128 << 20,
                   max_partitions: int = 100_000) -> int:
    """Size shuffles and file splits for an input of ``input_bytes``.

    Shuffle partitions ~ input / target (so a partition's share of a wide stage
    stays near ``target_bytes`` and spills little); AQE then coalesces small
    ones and splits skewed ones. Values the caller already set explicitly are
    kept. Returns the shuffle partition count in effect.
    """
    want = max(200, min(max_partitions, -(-input_bytes // target_bytes)))
    if spark.conf.get("spark.sql.shuffle.partitions", "200") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(want))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    if spark.conf.get("spark.sql.files.maxPartitionBytes", str(128 << 20)) == str(128 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
