"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.session import ensure_checkpoint_dir
from clonalyze.sources.tables import table

__all__ = ["table", "bounded_batches", "shared_path", "staged", "shuffle_partitions", "broadcast_if_small",
           "hot_aware_lookup", "Memo", "passed_through", "plain_names", "hash_sample"]

#: Arrow batch bound for Python stages: a worker holds a few batches of this size, however long the texts are.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch in this session, unless the caller already set a bound.

    Also lets Python workers on this machine import the package from where the driver did;
    on a cluster it is installed on the executors like any other library.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    current = spark.conf.get(key, None)
    if current in (None, "-1", "-1b", "9223372036854775807", "9223372036854775807b", "2147483647", "2147483647b"):
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what was staged,
    and branches that reuse it read only the columns they need.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a narrow lookup table is broadcast (a few long or short-string columns: some MB).
BROADCAST_ROWS = 100_000


def broadcast_if_small(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting ``small`` (stop counting beyond ``limit``)."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def hot_aware_lookup(big: DataFrame, lookup: DataFrame, keys: Sequence[str], n_col: str, total: int,
                     share: int = 1000) -> DataFrame:
    """Left join of ``big`` with ``lookup`` (one row per key; ``n_col`` = rows of ``big`` with it).

    Keys that hold more than ``total / share`` rows of ``big`` are at most ``share``
    many, so that part of ``lookup`` is broadcast with a proven bound and the hot rows
    are never shuffled to one task. All other keys take the ordinary shuffle join.
    Keys are matched null-safely. ``lookup`` should be staged, it is read twice.
    """
    values = [c for c in lookup.columns if c not in keys]
    hot = F.broadcast(lookup.filter(F.col(n_col) > total / share)
                      .select(*[F.col(k).alias(f"_hk_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values],
                              F.lit(True).alias("_h_hit")))
    marked = big.join(hot, _all_equal([(F.col(k), F.col(f"_hk_{k}")) for k in keys]), "left")
    hot_rows = marked.filter(F.col("_h_hit")).select(
        *[F.col(c) for c in big.columns], *[F.col(f"_hv_{v}").alias(v) for v in values])
    rest = lookup.filter(F.col(n_col) <= total / share).select(
        *[F.col(k).alias(f"_rk_{k}") for k in keys], *values)
    cold_rows = (marked.filter(F.col("_h_hit").isNull()).select(*big.columns)
                 .join(rest, _all_equal([(F.col(k), F.col(f"_rk_{k}")) for k in keys]), "left")
                 .select(*[F.col(c) for c in big.columns], *values))
    return hot_rows.unionByName(cold_rows)


def _all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    out = None
    for a, b in pairs:
        e = a.eqNullSafe(b)
        out = e if out is None else out & e
    return out


def hash_sample(df: DataFrame, rows: int, total: int, *cols: str) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df`` (all, if fewer), chosen by hash of ``cols``.

    A filter: the same rows on every run, and no task or driver sorts or merges candidates.
    """
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *[F.col(c) for c in cols]), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


class Memo:
    """A worker's bounded memo of two generations: what was used lately survives."""

    SIZE = 1 << 16

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.SIZE:
            self.old, self.young = self.young, {}
        self.young[key] = value


def passed_through(df: DataFrame, used: Sequence[str], compute, added: Sequence[tuple[str, str]]) -> DataFrame:
    """``df`` plus the ``added`` (name, type) columns, computed batch by batch in Python.

    ``compute`` maps the Arrow columns ``used`` of a batch to the added columns. All columns
    of ``df`` pass through, whatever their names; an added name replaces one of ``df``.
    """
    bounded_batches(df.sparkSession)
    names = list(df.columns)
    src = df.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(names)])
    at = [names.index(c) for c in used]
    n = len(names)

    def rows(batches):
        import pyarrow as pa
        for b in batches:
            new = compute(*[b.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f"_p{i}" for i in range(n + len(new))])

    schema = ", ".join([f"_p{i} {f.dataType.simpleString()}" for i, f in enumerate(src.schema)]
                       + [f"_p{n + i} {kind}" for i, (_, kind) in enumerate(added)])
    out = src.mapInArrow(rows, schema)
    fresh = [x for x, _ in added]
    return out.select(*[F.col(f"_p{i}").alias(c) for i, c in enumerate(names) if c not in fresh],
                      *[F.col(f"_p{n + i}").alias(c) for i, c in enumerate(fresh)])


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns _n0, _n1, ... that clash with nothing, and the new name of each column."""
    pos = {c: f"_n{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(pos[c]) for c in df.columns]), pos
