"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target: its weight's share of the budget, but at most ``cap``
times its own size, the excess reshared by weight until no source is above. A source
whose target is r times its size is taken floor(r) times whole; the rest comes from
the documents whose hash lies below a threshold. The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the running
sum passes the budget is refined by the next bits of the hash, and only its rows
are read again, until the bucket is one hash value. The document at the threshold
is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonalyze.llm.common import broadcast_if_small, plain_names, staged
from clonalyze.operators.dedupe import rank_within

HASH_BITS = 60
LEVEL_BITS = 12


def words(text: Column) -> Column:
    """Number of maximal runs outside white space (0x20, 0x09-0x0D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(id_col: Column, text: Column) -> Column:
    """60 bits of the MD5 of the identifier as text and the MD5 of the text (null: empty), as a long."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, cap: float) -> DataFrame:
    """(source, source_size) -> plus ``target``.

    Sources in code point order, null last, take ``weights`` in turn, repeated.
    """
    ranked = rank_within(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"]).drop("_null")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    s = staged(ranked.withColumn("_w", weight).drop("_rank"), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    goal = budget * total
    level, before = 0.0, -1
    limit = F.col("source_size") * F.lit(float(cap))
    while True:     # every turn caps at least one more source; a turn is one small aggregation
        is_capped = limit <= F.col("_w") * F.lit(level)
        row = s.agg(F.sum(F.when(is_capped, limit)), F.sum(F.when(~is_capped, F.col("_w"))), F.count_if(is_capped)).first()
        if row[2] == before or not row[1]:
            break
        before = row[2]
        level = (goal - (row[0] or 0.0)) / row[1]
    target = F.least(limit, F.col("_w") * F.lit(level)) if row[1] else limit
    return s.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, _h) rows -> one row per source: ``_whole``, ``_below``, ``_at``.

    A document is taken ``_whole`` times, and once more if its hash is < ``_below`` or,
    where ``_at`` is true, equal to it.
    """
    t = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = staged(t.withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-budgets")
    small = broadcast_if_small(t.select(F.col("source").alias("_s"), "_budget"))
    open_ = (docs.join(small, F.col("source").eqNullSafe(F.col("_s"))).filter("_budget > 0")
             .select("source", "size", "_h", "_budget", F.lit(0).cast("long").alias("_before")))
    shift = HASH_BITS
    while True:
        shift -= LEVEL_BITS
        bucket = F.expr(f"shiftright(_h, {shift})")
        hist = open_.groupBy("source", "_budget", "_before", bucket.alias("_b")).agg(F.sum("size").alias("_sum"))
        # at most 2 ** LEVEL_BITS rows of a source
        run = hist.withColumn("_to", F.col("_before") + F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")))
        edge = (run.filter("_to >= _budget").groupBy("source")
                .agg(F.min_by(F.struct("_b", (F.col("_to") - F.col("_sum")).alias("_before"), "_to", "_budget"), "_b").alias("_e"))
                .select(F.col("source").alias("_s"), "_e.*"))
        edge = staged(edge, "mix-edge")
        if shift == 0:
            break
        e = broadcast_if_small(edge.select("_s", F.col("_b").alias("_eb"), F.col("_before").alias("_eb_before")))
        open_ = staged(open_.join(e, F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_eb")))
                       .select("source", "size", "_h", "_budget", F.col("_eb_before").alias("_before")), "mix-bucket")
    found = edge.select("_s", F.col("_b").alias("_below"),
                        ((F.col("_to") - F.col("_budget")) < (F.col("_budget") - F.col("_before"))).alias("_at"))
    # a budget that no running sum reaches takes every hash
    return (t.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", "source_size", "target", "_whole",
                    F.when(F.col("_budget") > 0, F.coalesce("_below", F.lit(1 << HASH_BITS))).otherwise(0).alias("_below"),
                    F.coalesce("_at", F.lit(False)).alias("_at")))


def mix(df: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``df`` with the decision on it.

    Adds ``_size`` (words), ``_source_size``, ``_target`` (of the source) and ``_copies``
    (times the mix takes the document), in place of columns of these names. Null text has size 0; a null source is a source
    like any other, last in order; rows with the same identifier and text share their hash and are
    taken together; rows that only share a null or repeated identifier are not. A source without words has target 0. An empty
    table gives an empty result. Reruns agree: the hash is of identifier and text alone.
    """
    spark = df.sparkSession
    names = df.columns
    slim = staged(df.select(F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"),
                            row_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_h")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = staged(thresholds(slim, source_targets(sizes, weights, budget, cap)), "mix-thresholds")
    small = broadcast_if_small(plan.select(*[F.col(c).alias(f"_mx_{c}") for c in plan.columns]))
    own = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    pos = {c: f"_c{i}" for i, c in enumerate(names)}
    joined = own.join(small, F.col(pos[source_col]).eqNullSafe(F.col("_mx_source")), "left")
    h = row_hash(F.col(pos[id_col]), F.col(pos[text_col]))
    extra = (h < F.col("_mx__below")) | ((h == F.col("_mx__below")) & F.col("_mx__at"))
    return joined.select(
        *[F.col(pos[c]).alias(c) for c in names if c not in ("_size", "_source_size", "_target", "_copies")], words(F.col(pos[text_col])).alias("_size"),
        F.col("_mx_source_size").alias("_source_size"), F.col("_mx_target").alias("_target"),
        (F.col("_mx__whole") + F.when(extra, 1).otherwise(0)).cast("long").alias("_copies"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken."""
    own, pos = plain_names(df)
    taken = mix(own, id_col=pos[id_col], text_col=pos[text_col], source_col=pos[source_col], **options)
    return (taken.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .select(*[F.col(pos[c]).alias(c) for c in df.columns]))
