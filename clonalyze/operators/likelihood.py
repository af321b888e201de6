"""Pseudo-log-likelihood of a sequence window under a residue model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.residues import SKIP_CHARS


def pseudo_log_likelihood(scored: DataFrame, keys: Sequence[str], skip: str = SKIP_CHARS) -> DataFrame:
    """Mean natural log of P(observed residue) per key.

    ``scored`` is a residue table with ``prob`` (one row per residue, or one row
    with null ``aa`` for an empty window). Gap / stop characters are skipped, an
    empty window gives a null score, and a failed model call (``error`` column
    set on any row of the sequence) makes the whole score null.
    """
    ok = F.col("aa").isNotNull() & ~F.col("aa").isin(*skip)
    lp = F.when(ok, F.ln("prob"))
    aggs = [F.count(lp).cast("long").alias("n_pos"), F.avg(lp).alias("pll")]
    if "error" in scored.columns:
        aggs.append(F.max("error").alias("error"))
    out = scored.groupBy(*keys).agg(*aggs)
    if "error" in scored.columns:
        out = out.withColumn("pll", F.when(F.col("error").isNull(), F.col("pll")))
    return out
