"""File sources (A1-A8, A14): CSV / JSONL / Parquet / text / gzip readers with
explicit schemas (no inference pass), one glob read per source - never a
driver-side loop over folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonalyze.schemas import CONSENSUS_SCHEMA, CONTIG_SCHEMA, LABELLED_SCHEMA, OAS_FIELDS


def _with_id(df: DataFrame, file: Column | None = None) -> DataFrame:
    """``seq_id`` from the file's name and the row's content, so it survives re-runs, other
    file splits and other folders. Equal rows of one file are told apart by number.

    Rows are numbered inside their input partition and shifted by the equal rows of earlier
    partitions (a count per content and partition), so a file of a million equal rows spreads over as many tasks as it has splits.
    """
    names = df.columns
    tagged = df.select("*", F.xxhash64(F.element_at(F.split(F.input_file_name() if file is None else file, "/"), -1),
                                       *[F.col(f"`{c}`") for c in names]).alias("_content"), F.spark_partition_id().alias("_pid"))
    here = Window.partitionBy("_pid", "_content").orderBy("_content")
    earlier = Window.partitionBy("_content").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy("_content", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    shift = (counts.withColumn("_before", F.sum("_n").over(earlier)).filter("_before is not null")
             .select(F.col("_content").alias("_sc"), F.col("_pid").alias("_sp"), "_before"))
    numbered = tagged.withColumn("_k", F.row_number().over(here)).join(shift, (F.col("_content") == F.col("_sc")) & (F.col("_pid") == F.col("_sp")), "left")
    nth = F.col("_k") + F.coalesce("_before", F.lit(0))
    return numbered.select(*[F.col(f"`{c}`") for c in names], F.when(nth == 1, F.col("_content")).otherwise(F.xxhash64("_content", nth)).alias("seq_id"))


def read_sequences(spark: SparkSession, path: str | Sequence[str], col: str = "sequence") -> DataFrame:
    """A1: one column of a header CSV (default ``sequence``); nulls are kept as nulls."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if col not in df.columns:
        raise ValueError(f"column {col!r} not in {df.columns}")
    return _with_id(df.select(F.col(col).alias("sequence")))


def read_contigs(spark: SparkSession, root: str, file_name: str = "filtered_contig_annotations.csv") -> DataFrame:
    """A2: every sample folder's contig CSV in one read; ``sample_id`` = folder name."""
    df = spark.read.schema(CONTIG_SCHEMA).option("header", True).csv(f"{root.rstrip('/')}/*/{file_name}")
    sample = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return _with_id(df.withColumn("sample_id", sample))


def read_consensus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A3: consensus CSVs of several folders stacked, with the folder as ``source``."""
    df = spark.read.schema(CONSENSUS_SCHEMA).option("header", True).csv(list(paths))
    return _with_id(df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


def read_wide_embeddings(spark: SparkSession, path: str, prefix: str = "dim_") -> DataFrame:
    """A4: (gzip) CSV with ``dim_0..dim_{n-1}`` columns -> metadata + one ``array<double>``
    ordered by the numeric suffix (not by name: dim_10 comes after dim_9)."""
    df = spark.read.option("header", True).csv(path)
    dims = sorted([c for c in df.columns if c.startswith(prefix)], key=lambda c: int(c[len(prefix):]))
    meta = [c for c in df.columns if not c.startswith(prefix)]
    out = df.select(*meta, F.array(*[F.col(c).cast("double") for c in dims]).alias("vec"))
    return out if "seq_id" in meta else _with_id(out)


def read_corpus(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A5: line / whitespace separated sequences (a line may hold many)."""
    t = spark.read.text(path)
    return _with_id(t.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("sequence")).filter(F.length("sequence") > 0))


def read_labelled(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON lines (sequence, label)."""
    return _with_id(spark.read.schema(LABELLED_SCHEMA).json(path))


def read_token_labels(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet with an array label column (``paratope_labels``)."""
    df = spark.read.parquet(path)
    return df if "seq_id" in df.columns else _with_id(df)


def read_oas(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Public antibody data units (gzip CSV: one metadata line, one header
    line, then rows; fields by position). Each gzip file is one task (not
    splittable); the metadata and header lines are recognised by content, so the
    read needs no per-file line numbers."""
    width = max(OAS_FIELDS.values())
    schema = ", ".join(f"f{i} string" for i in range(1, width + 1))   # positional; later fields are ignored
    raw = spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"').csv(paths)
    picked = raw.select(*[F.col(f"f{i}").alias(name) for name, i in OAS_FIELDS.items()], F.col("f1").alias("_first"))
    meta_line = F.coalesce(F.col("_first"), F.lit("")).startswith("{")
    header_line = F.col("sequence_alignment_aa").eqNullSafe(F.lit("sequence_alignment_aa"))
    body = picked.filter(~meta_line & ~header_line)
    return _with_id(body.drop("_first"))


def ingest_oas(spark: SparkSession, manifest: Sequence[str], out_path: str | None = None) -> DataFrame:
    """The manifest's units read in parallel (one task per file), filtered (B5) and
    written once; the old 50-way shard-and-concatenate becomes partitioning."""
    from clonalyze.operators.filters import oas_quality

    df = oas_quality(read_oas(spark, list(manifest))).select("seq_id", "sequence_alignment_aa")
    if out_path:
        df.select("sequence_alignment_aa").write.mode("overwrite").text(out_path)
    return df
