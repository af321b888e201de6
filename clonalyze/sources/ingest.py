"""Resumable ingestion of sequence units (A14): units packed by size into tasks, finished ones in a ledger.

A unit is a (gzip) CSV that can't be split: one metadata line, one header line, then rows, fields by position.
The pending units are taken in waves of a bounded size; a wave is one Spark job whose tasks each read a bin of units,
longest first into the emptiest bin, so that tasks end together as long as no single unit is larger than a task's share.
A wave's rows are written to a folder of their own, and only then are its units entered in the ledger: what a killed run
leaves behind is never read, and a re-run reads only units that the ledger lacks.
"""

from __future__ import annotations

import csv
import gzip
import heapq
import io
import itertools
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.operators.filters import oas_quality
from clonalyze.operators.joins import null_safe_join
from clonalyze.schemas import OAS_FIELDS
from clonalyze.sources.sinks import exists, pending

BATCH_ROWS = 8192
LEDGER = "unit string, bytes long, task int, run string, kept long"
ROWS = "unit string, line long, " + ", ".join(f"{c} string" for c in OAS_FIELDS)


def pack(sizes: Sequence[tuple[str, int]], bins: int) -> list[list[str]]:
    """Units to at most ``bins`` bins, longest first, each into the bin that holds least so far (ties: first bin)."""
    full = [(0, i) for i in range(min(bins, len(sizes)))]
    out: list[list[str]] = [[] for _ in full]
    for unit, size in sorted(sizes, key=lambda u: (-u[1], u[0])):
        held, i = heapq.heappop(full)
        out[i].append(unit)
        heapq.heappush(full, (held + size, i))
    return out


def waves(sizes: Sequence[tuple[str, int]], wave_bytes: int) -> Iterator[list[tuple[str, int]]]:
    """Units in path order, cut where a wave would pass ``wave_bytes`` (a larger unit is a wave of its own)."""
    own: list[tuple[str, int]] = []
    for unit in sorted(sizes):
        if own and sum(s for _, s in own) + unit[1] > wave_bytes:
            yield own
            own = []
        own.append(unit)
    if own:
        yield own


def unit_sizes(spark: SparkSession, manifest: Sequence[str]) -> DataFrame:
    """(unit, bytes) of the manifest's files or globs; no content is read. A unit named twice counts once."""
    files = spark.read.format("binaryFile").load(list(manifest)).select(F.col("path").alias("unit"), F.col("length").alias("bytes"))
    return files.dropDuplicates(["unit"])


def _open(uri: str) -> io.BufferedIOBase:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_stream("/" + uri[5:].lstrip("/"), compression=None)
    head, path = re.match(r"([^:/]+://[^/]*)(/.*)", uri).groups()
    fs, base = pafs.FileSystem.from_uri(head + "/")
    return fs.open_input_stream(base.rstrip("/") + path, compression=None)


def unit_rows(uri: str) -> Iterator[tuple]:
    """(unit, line, fields) of a unit, read as a stream; empty fields are null, metadata and header lines are left out."""
    csv.field_size_limit(1 << 30)
    with _open(uri) as raw:
        body = gzip.GzipFile(fileobj=raw) if uri.endswith((".gz", ".gzip")) else raw
        reader = csv.reader(io.TextIOWrapper(body, encoding="utf-8", errors="replace", newline=""))
        for line, row in enumerate(reader, 1):
            if row and not row[0].startswith("{"):
                fields = [(row[i - 1] or None) if i <= len(row) else None for i in OAS_FIELDS.values()]
                if fields[0] != "sequence_alignment_aa":
                    yield (uri, line, *fields)


def _parser(bins: list[list[str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                rows = itertools.chain.from_iterable(unit_rows(unit) for unit in bins[i])
                while chunk := list(itertools.islice(rows, BATCH_ROWS)):
                    yield pd.DataFrame(chunk, columns=["unit", "line", *OAS_FIELDS])
    return parse


def read_bins(spark: SparkSession, bins: list[list[str]]) -> DataFrame:
    """Rows of the packed units, one task a bin. ``seq_id`` comes from the unit's file name and line, so it survives
    re-runs, other folders and other packings without a shuffle."""
    rows = spark.range(0, len(bins), 1, len(bins)).mapInPandas(_parser(bins), ROWS)
    name = F.element_at(F.split("unit", "/"), -1)
    return rows.select(F.xxhash64(name, "line").alias("seq_id"), "unit", *OAS_FIELDS)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """Finished units: (unit, bytes, task, run, kept)."""
    path = f"{out.rstrip('/')}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def ingest_units(spark: SparkSession, manifest: Sequence[str], out: str, tasks: int | None = None, wave_bytes: int = 64 << 30,
                 keep: Callable[[DataFrame], DataFrame] = oas_quality) -> DataFrame:
    """Read the manifest's units that ``out`` (a folder all nodes share) doesn't hold yet; return all finished rows.

    ``tasks`` bins a wave (default: the session's parallelism). A unit that can't be read to its end fails its wave;
    finished waves stay. The driver holds paths and sizes of the manifest, never rows.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    todo = [(r.unit, r.bytes) for r in pending(unit_sizes(spark, manifest), ledger(spark, out), ["unit"]).collect()]
    for wave in waves(todo, wave_bytes):
        bins, run = pack(wave, tasks), uuid.uuid4().hex
        keep(read_bins(spark, bins)).select("seq_id", "unit", "sequence_alignment_aa").write.parquet(f"{out.rstrip('/')}/run-{run}")
        sizes = dict(wave)
        units = spark.createDataFrame([(u, sizes[u], i, run) for i, b in enumerate(bins) for u in b], "unit string, bytes long, task int, run string")
        kept = spark.read.parquet(f"{out.rstrip('/')}/run-{run}").groupBy("unit").agg(F.count(F.lit(1)).alias("kept"))
        done = null_safe_join(units, kept, ["unit"], "left").select("unit", "bytes", "task", "run", F.coalesce("kept", F.lit(0)).alias("kept"))
        done.coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}/ledger")      # one row a unit of the wave
    return finished(spark, out)


def finished(spark: SparkSession, out: str) -> DataFrame:
    """(seq_id, unit, sequence_alignment_aa) of the units in the ledger."""
    runs = [r.run for r in ledger(spark, out).select("run").distinct().collect()]       # one a wave
    schema = "seq_id long, unit string, sequence_alignment_aa string"
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out.rstrip('/')}/run-{r}" for r in sorted(runs)])
