"""Joins (C1-C16) with the table semantics of the analysed workflow.

Two differences from plain SQL joins are kept on purpose: null keys match each
other (``eqNullSafe``), and a *natural* join uses every shared column.
No operator here emits all pairs of a group: pair tables always come from an
explicit edge list (lineage edges, sequence -> germline, candidate edges).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; key columns appear once."""
    # the right side gets names (and attributes) of its own: both sides may come from one table
    bb = b.select(*[F.col(c).alias(f"__r_{c}") for c in b.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    j = a.join(bb, cond, how)
    key_cols = [F.coalesce(k, f"__r_{k}").alias(k) if how in ("full", "outer", "right") else F.col(k) for k in keys]
    return j.select(*key_cols, *[F.col(c) for c in a.columns if c not in keys], *[F.col(f"__r_{c}").alias(c) for c in b.columns if c not in keys])


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared columns, null-safe (pandas ``merge`` without ``on``)."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("natural_join needs at least one shared column")
    return null_safe_join(a, b, shared, how)


def suffixed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner",
                  suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on ``keys``; other clashing columns get ``_x`` / ``_y`` like pandas."""
    clash = [c for c in a.columns if c in b.columns and c not in keys]
    aa = a.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in a.columns])
    bb = b.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in b.columns])
    return null_safe_join(aa, bb, list(keys), how)


def attach_repertoire(emb: DataFrame, rep: DataFrame, barcode_only: bool = False) -> DataFrame:
    """C4: embedding rows to repertoire rows. Barcodes repeat across samples, so the
    default key is (sample_id, barcode); ``barcode_only`` keeps the pooled m:n meaning."""
    keys = ["barcode"] if barcode_only else ["sample_id", "barcode"]
    return suffixed_join(emb, rep, keys)


def enrich(obs: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of extra metadata; columns already present in ``obs`` are not duplicated."""
    extra = [c for c in meta.columns if c not in obs.columns]
    return null_safe_join(obs, meta.select(*keys, *extra), list(keys), "left")


def multi_member(df: DataFrame, key: Sequence[str] | str, min_n: int = 2, distinct_of: str | None = None) -> DataFrame:
    """Keep rows of groups with at least ``min_n`` members (or distinct values of a column).

    Counting is a partial aggregation; the semi join lets AQE split a hot group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    n = F.countDistinct(distinct_of) if distinct_of else F.count("*")
    big = df.groupBy(*keys).agg(n.alias("_n")).filter(F.col("_n") >= min_n).select(*keys)
    return df.join(big, keys, "left_semi")


def attach_germline(germ: DataFrame, rep: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Germline rows to repertoire rows (inner, or left for un-recombined germlines)."""
    return null_safe_join(germ, rep, list(keys), how)


def mirror_pairs(pairs: DataFrame, src: str = "src", dst: str = "dst", value: str = "velocity") -> DataFrame:
    """C8 (antisymmetric part): add (dst, src, -value) for every (src, dst, value)."""
    others = [c for c in pairs.columns if c not in (src, dst, value)]
    back = pairs.select(*others, F.col(dst).alias(src), F.col(src).alias(dst), (-F.col(value)).alias(value))
    return pairs.select(*others, src, dst, value).unionByName(back)


def edge_sequences(nodes: DataFrame, edges: DataFrame, reverse: bool = False, group: str = "sample_clonotype",
                   label: str = "label", seq: str = "network_sequences", i: str = "i", j: str = "j", usable: bool = False) -> DataFrame:
    """Each edge with its parent and child sequences (equi-joins on (group, label): null matches nothing, a node that comes
    twice gives two rows).

    ``reverse`` swaps parent and child, as in the reversed substitution table; ``usable`` drops the edges from and to the germline,
    the largest label of the tree (B18). Nodes and edges are shuffled once, by tree: both ends, and both directions, are looked
    up where the tree was dealt, by sorting its rows by label. The nearly equal sequences of a tree travel side by side, so they
    take little room, and no sequence moves a second time.
    """
    both = (nodes.select(F.col(group).alias("_g"), F.col(label).alias("_i"), F.lit(None).cast(edges.schema[j].dataType).alias("_j"), F.struct(F.col(seq).alias("_s")).alias("_n"))
            .filter("_g is not null and _i is not null"))
    own = edges.select(F.col(group).alias("_g"), F.col(i).alias("_i"), F.col(j).alias("_j"), F.lit(None).cast(both.schema["_n"].dataType).alias("_n"))
    # an explicit exchange: the windows below are content with it, joins on (group, label) would move all rows again
    rows = both.unionByName(own.filter("_g is not null and _i is not null and _j is not null")).repartition("_g")
    is_edge = F.col("_n").isNull()
    if usable:
        rows = rows.withColumn("_top", F.max(F.when(~is_edge, F.col("_i"))).over(Window.partitionBy("_g")))
        rows = rows.filter(~is_edge | ((F.col("_i") != F.col("_top")) & (F.col("_j") != F.col("_top"))))
    ends = ("_j", "_i") if reverse else ("_i", "_j")
    for n, end in enumerate(ends, 1):
        rows = rows.withColumn("_at", F.when(is_edge, F.col(end)).otherwise(F.col("_i")))
        rows = rows.withColumn(f"_seqs_{n}", F.collect_list("_n").over(Window.partitionBy("_g", "_at")))
    out = rows.filter(is_edge).select(F.col("_g").alias(group), F.col(ends[0]).alias("parent"), F.col(ends[1]).alias("child"),
                                      F.inline("_seqs_1").alias("seq_1"), "_seqs_2")
    return out.select(group, "parent", "child", "seq_1", F.inline("_seqs_2").alias("seq_2"))


def join_on_id(a: DataFrame, b: DataFrame, id: str = "seq_id") -> DataFrame:
    """Row-aligned concat becomes a key join."""
    return a.join(b, id)


def cluster_germline(clusters: DataFrame, germ: DataFrame, cluster: str = "cluster", clonotype: str = "clonotype",
                     order: str = "seq_id") -> DataFrame:
    """Germline of a cluster = germline of its most frequent clonotype (ties: smaller clonotype)."""
    # one row per (cluster, clonotype) after a partial aggregation, so the window
    # over a cluster holds its clonotype counts, not its members
    counts = clusters.groupBy(cluster, clonotype).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(cluster).orderBy(F.col("_n").desc(), F.col(clonotype).asc())
    top = counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(cluster, F.col(clonotype).alias("_top"))
    return top.join(germ, top["_top"] == germ[clonotype]).drop("_top")


def map_samples(df: DataFrame, mapping: DataFrame, src: str = "original_sample_id", dst: str = "sample_id") -> DataFrame:
    """Rename samples through a distinct mapping table (small: one row per sample)."""
    m = mapping.select(src, dst).distinct()
    return df.join(m, src, "inner")
