"""Deterministic de-duplication, ranking, sampling and stacking.

Every order-dependent operator orders by a unique key last, so re-runs and the
partition count never change the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonalyze.operators.joins import null_safe_join


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def stack(*dfs: DataFrame, allow_missing: bool = True) -> DataFrame:
    """Stack tables by column name (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def keep_first(df: DataFrame, keys, order: str | Sequence[str] = "seq_id") -> DataFrame:
    """First row per key by ``order`` (``dropDuplicates`` keeps an arbitrary row).

    Every partition keeps one row per key before the shuffle (window group limit), so a
    key holding a third of the table sends one row per partition.
    """
    w = Window.partitionBy(*_keys(keys)).orderBy(*_keys(order))
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").select(*df.columns)


def distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values / pairs."""
    return df.select(*cols).distinct()


def representatives(df: DataFrame, key: str | Sequence[str], id: str, order: str = "seq_id") -> DataFrame:
    """One representative id per key (first by ``order``), plus the group size."""
    keys = _keys(key)
    return df.groupBy(*keys).agg(F.min_by(id, order).alias(id), F.count("*").cast("long").alias("n"))


def rank_within(df: DataFrame, keys, order, out: str = "_rank") -> DataFrame:
    """1-based row number by ``order`` inside each key, without a key ever sitting in one task.

    The table is range-partitioned on (keys, order), numbered locally inside each
    range partition, and shifted by the row counts of the earlier partitions of
    the same key (a small table: partitions x keys). A key holding a third of the
    rows spans many range partitions, so the work stays spread. ``order`` must end
    with a unique column for a deterministic result.
    """
    from clonalyze.session import cut_lineage

    keys, order = _keys(keys), _keys(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample and are not stable between two
    # evaluations, so the partitioned rows are checkpointed once and both the
    # local numbering and the offsets read the same copy.
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)))
    counts = ranged.groupBy(*keys, "_pid").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    joined = null_safe_join(local, offsets, [*keys, "_pid"])
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_lr") + F.col("_off")).cast("long").alias(out))


def head_per(df: DataFrame, cls: str, n: int, order: str = "seq_id") -> DataFrame:
    """first ``n`` rows per class (by ``order``); null is a class like any other.

    For a small ``n`` every partition keeps its own first ``n`` rows of a class before
    the shuffle (window group limit); a large ``n`` takes the distributed ranking.
    """
    if n < 1000:
        w = Window.partitionBy(cls).orderBy(order)
        return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
    return rank_within(df, cls, order).filter(F.col("_rank") <= n).drop("_rank")


def undersample(df: DataFrame, cls: str, order: str = "seq_id") -> DataFrame:
    """Every class cut to the size of the smallest class (first rows by ``order``)."""
    counts = df.groupBy(cls).agg(F.count("*").alias("_n"))
    smallest = counts.agg(F.min("_n").alias("_m")).first()["_m"]  # one number, from a one-row-per-class table
    return head_per(df, cls, int(smallest or 0), order)


def top_groups(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """the k most frequent values (ties: smaller value first)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").cast("long").alias("n"))
            .orderBy(F.col("n").desc(), F.col(col).asc()).limit(k))


def mode_of(df: DataFrame, group: str | Sequence[str], col: str) -> DataFrame:
    """most frequent value of ``col`` per group (ties: smaller value), with its count.

    Works on the (group, value) count table, so a hot group contributes one row per
    distinct value, not one per member.
    """
    g = _keys(group)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*g).agg(F.max("_n").alias("_n"))
    return counts.join(best, [*g, "_n"]).groupBy(*g).agg(F.min(col).alias(col), F.max("_n").cast("long").alias("n"))


def factorize(df: DataFrame, col: str, order: str = "seq_id", out: str | None = None) -> DataFrame:
    """dense integer codes (0-based) by first appearance.

    The distinct values with their first position form one row per value; they
    are ranked with ``rank_within`` (no single-partition window) and joined back.
    """
    out = out or f"{col}_code"
    firsts = df.groupBy(col).agg(F.min(order).alias("_first"))
    codes = rank_within(firsts, [], ["_first", col]).select(col, (F.col("_rank") - 1).cast("int").alias(out))
    return df.join(codes, col, "left")


def head(df: DataFrame, n: int, order: Sequence[str] | str = "seq_id") -> DataFrame:
    """First n rows by order (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(*_keys(order)).limit(n)

