"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, an external sort places
equal texts next to each other, and full comparisons of neighbours find the runs
of equal texts; the smallest identifier of a run is retained.

The splitters are bounded: a key is the first ``PREFIX`` characters of the
normalised text, its 64-bit hash and the identifier, so the sample that Spark
draws for them does not grow with text length. The identifier as last key part
lets a hot text (a third of all rows) spread over many range partitions; runs
that cross a partition edge are joined again from at most a few edge rows per
partition, compared by their full text. Equality is always decided on the whole
normalised bytes, the hash only orders them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clonalyze.llm.common import bounded_batches, plain_names, shuffle_partitions, staged

PREFIX = 48
_WS = b" \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Each run of white space (0x20, 0x09-0x0D) becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def normalised_bytes(raw: bytes | None) -> bytes:
    """The same for one value in UTF-8."""
    if not raw:
        return b""
    body = b" ".join(raw.split())
    if not body:
        return b" "
    return (b" " if raw[0] in _WS else b"") + body + (b" " if raw[-1] in _WS else b"")


class _Runs:
    """Runs of equal texts in one sorted partition, fed row by row.

    Rows with the same hash form a class; a class normally holds one run. Runs of the
    partition's first and last class may go on in a neighbouring partition (edges).
    """

    def __init__(self, partition: int):
        self.next_run = partition << 40
        self.hash = None
        self.first_class = True
        self.open: list[list] = []       # [text, run, keep_id, rows]
        self.closed: list[list] = []     # of the batch under way
        self.edges: list[list] = []

    def feed(self, h: int, text: bytes, doc_id) -> tuple[int, object, bool]:
        if h != self.hash:
            self._close()
            self.hash = h
        for r in self.open:
            if r[0] == text:
                r[3] += 1
                return r[1], r[2], False
        self.open.append([text, self.next_run, doc_id, 1])
        self.next_run += 1
        return self.open[-1][1], doc_id, True

    def _close(self, last: bool = False) -> None:
        if self.hash is None:
            return
        if self.first_class or last:
            self.edges += self.open
        else:
            self.closed += [r for r in self.open if r[3] > 1]
        self.first_class = False
        self.open = []

    def finish(self) -> None:
        self._close(last=True)


def _run_rows(carried: list[str], id_col: str, text_col: str, out_schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(TaskContext.get().partitionId())

        def extra(kind: int, found: list[list]) -> pa.RecordBatch:
            n = len(found)
            cols = {f: pa.nulls(n, out_schema.field(f).type) for f in out_schema.names}
            cols["_kind"] = pa.array([kind] * n, pa.int8())
            cols["_run"] = pa.array([r[1] for r in found], pa.int64())
            cols["_keep"] = pa.array([r[2] for r in found], out_schema.field("_keep").type)
            cols["_rows"] = pa.array([r[3] for r in found], pa.int64())
            cols["_edge_text"] = pa.array([r[0] if kind == 2 else None for r in found], pa.binary())
            return pa.RecordBatch.from_arrays([cols[f] for f in out_schema.names], schema=out_schema)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            run, first = np.empty(n, np.int64), np.empty(n, bool)
            keep, sha = [None] * n, [None] * n
            ids, hashes, texts = b.column(id_col).to_pylist(), b.column("_hash").to_pylist(), b.column(text_col).cast(pa.binary()).to_pylist()
            prev, digest = None, None
            for i in range(n):
                norm = normalised_bytes(texts[i])
                run[i], keep[i], first[i] = runs.feed(hashes[i], norm, ids[i])
                if norm != prev:
                    prev, digest = norm, hashlib.sha256(norm).hexdigest()
                sha[i] = digest
            cols = {c: b.column(c) for c in carried}
            cols |= {"_kind": pa.array(np.zeros(n, np.int8)), "_run": pa.array(run), "_first": pa.array(first),
                     "_keep": pa.array(keep, out_schema.field("_keep").type), "_sha": pa.array(sha, pa.string()),
                     "_rows": pa.nulls(n, pa.int64()), "_edge_text": pa.nulls(n, pa.binary())}
            yield pa.RecordBatch.from_arrays([cols[f].cast(out_schema.field(f).type) for f in out_schema.names], schema=out_schema)
            if runs.closed:
                yield extra(1, runs.closed)
                runs.closed = []
        runs.finish()
        if runs.closed:
            yield extra(1, runs.closed)
        for e in runs.edges:
            yield extra(2, [e])

    return rows


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """Every row of ``df`` with the decision on it.

    Adds ``_keep_id`` (smallest identifier of the equal texts), ``_kept`` (exactly one
    row of each group of equal texts), ``_group_size`` and ``_sha256`` (of the
    normalised text). ``carry_text=False`` leaves the text column out.

    Null text counts as empty; null identifiers sort after all others, so they stay only
    where every row of the group has none (``_keep_id`` is then null). Repeated rows are
    equal texts like any other: one of them stays. An empty table gives an empty result.
    Columns of these names are replaced, all others pass through.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    renamed = df.select(*[F.col(f"`{c}`").alias(f"_xd_{i}") for i, c in enumerate(df.columns)])
    pos = {c: f"_xd_{i}" for i, c in enumerate(df.columns)}
    rid, rtext = pos[id_col], pos[text_col]
    norm = normalised(F.col(rtext))
    keyed = renamed.withColumn("_prefix", F.substring(norm, 1, PREFIX)).withColumn("_hash", F.xxhash64(norm))
    order = [F.col("_prefix"), F.col("_hash"), F.col(rid).asc_nulls_last()]
    ordered = (keyed.repartitionByRange(shuffle_partitions(spark), *order)
               .sortWithinPartitions(*order).drop("_prefix"))
    carried = [pos[c] for c in df.columns if carry_text or c != text_col]
    schema = T.StructType([renamed.schema[c] for c in carried] + [
        T.StructField("_kind", T.ByteType()), T.StructField("_run", T.LongType()), T.StructField("_first", T.BooleanType()),
        T.StructField("_keep", renamed.schema[rid].dataType), T.StructField("_sha", T.StringType()),
        T.StructField("_rows", T.LongType()), T.StructField("_edge_text", T.BinaryType())])
    for f in schema:
        f.nullable = True
    runs = staged(ordered.mapInArrow(_run_rows(carried, rid, rtext, to_arrow_schema(schema)), schema), "content-sort")
    rows = runs.filter("_kind = 0").drop("_kind", "_rows", "_edge_text")
    inner = runs.filter("_kind = 1").select(F.col("_run").alias("_in_run"), F.col("_rows").alias("_in_rows"))
    # edges: one row per run at a partition edge, so a few per range partition
    edges = (runs.filter("_kind = 2").groupBy("_edge_text")
             .agg(F.min("_run").alias("_keep_run"), F.min_by("_keep", "_run").alias("_keep_all"),
                  F.sum("_rows").alias("_edge_rows"), F.collect_list("_run").alias("_runs"))
             .select(F.explode("_runs").alias("_edge_run"), "_keep_run", "_keep_all", "_edge_rows"))
    out = (rows.join(F.broadcast(edges), F.col("_run") == F.col("_edge_run"), "left")
           .join(inner, F.col("_run") == F.col("_in_run"), "left"))
    at_edge = F.col("_edge_run").isNotNull()
    return out.select(
        *[F.col(pos[c]).alias(c) for c in df.columns
          if (carry_text or c != text_col) and c not in ("_keep_id", "_kept", "_group_size", "_sha256")],
        F.when(at_edge, F.col("_keep_all")).otherwise(F.col("_keep")).alias("_keep_id"),
        (F.col("_first") & F.coalesce(F.col("_run") == F.col("_keep_run"), F.lit(True))).alias("_kept"),
        F.coalesce("_edge_rows", "_in_rows", F.lit(1)).cast("long").alias("_group_size"),
        F.col("_sha").alias("_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of equal normalised texts, the one with the smallest identifier."""
    own, pos = plain_names(df)
    return content_sort(own, pos[id_col], pos[text_col]).filter("_kept").select(*[F.col(pos[c]).alias(c) for c in df.columns])
