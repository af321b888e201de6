"""K1: incremental scoring of newly arrived sample folders.

A file-source stream over ``<in_path>/<sample>/*.csv`` triggered with
``availableNow`` processes whatever arrived since the last run; each micro-batch
is scored with a model fitted beforehand (its count table is read from Parquet,
so every batch uses the same model and the result equals the batch job), keys
already present in the output are skipped (left anti join), and the rows are
appended. The checkpoint folder records which files were consumed, so a
restarted or re-run job neither loses nor repeats work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.operators.models import ContextModel
from clonalyze.schemas import CONTIG_SCHEMA

KEYS = ["sample_id", "contig_id", "mode", "model"]
PARTITIONS = ["model", "mode", "sample_id"]
OUTPUT = "contig_id string, chain string, n_pos bigint, pll double, model string, mode string, sample_id string"


def save_model(model: ContextModel, path: str) -> None:
    model.counts.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> ContextModel:
    counts = spark.read.parquet(path)
    m = ContextModel(by=[c for c in counts.columns if c not in ("left", "right", "aa", "n")])
    m.counts = counts
    return m


def score_batch(contigs: DataFrame, model: ContextModel, modes: Sequence[str], name: str = "context") -> DataFrame:
    """J4 for one batch with the stream's key columns."""
    from clonalyze.plans.scoring import score

    return score(contigs, modes, {name: model}, keys=["sample_id", "contig_id", "chain"])


def written(spark: SparkSession, path: str, name: str, modes: Sequence[str], samples: Sequence[str]) -> DataFrame | None:
    """Keys written for these samples: only their partitions are read. None before the first write."""
    try:
        out = spark.read.schema(OUTPUT).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return out.filter((F.col("model") == name) & F.col("mode").isin(list(modes)) & F.col("sample_id").isin(list(samples))).select(*KEYS)


def score_stream(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, model_path: str,
                 modes: Sequence[str] = ("full_VDJ", "cdr3_from_VDJ"), name: str = "context") -> None:
    """Run until every file present now is scored by the model ``name`` (``availableNow``), then stop.

    The output is partitioned by model, mode and sample. Every model has a checkpoint of its own.
    """
    model = load_model(spark, model_path)
    stream = (spark.readStream.schema(CONTIG_SCHEMA).option("header", True)
              .option("recursiveFileLookup", False).csv(f"{in_path.rstrip('/')}/*/")
              .withColumn("sample_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)))

    def run(batch: DataFrame, epoch: int) -> None:
        scored = score_batch(batch, model, modes, name)
        samples = [r[0] for r in batch.select("sample_id").distinct().collect()]     # folders that arrived
        done = written(spark, out_path, name, modes, samples)
        if done is not None:
            scored = scored.join(done, KEYS, "left_anti")
        scored.write.mode("append").partitionBy(*PARTITIONS).parquet(out_path)

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
