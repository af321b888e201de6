"""Row filters and tag columns (B1-B6, B11-B18). All are narrow and push down
to the Parquet scan where the predicate is on a stored column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.residues import fill_vector, vector_complete

# Region-length quality bounds for public antibody data units
# (fwr1 >= 20, fwr4 >= 10, 5 <= cdr1 <= 12, 1 <= cdr2 <= 10, 5 <= cdr3 <= 38).
OAS_BOUNDS = {"fwr1": (20, None), "fwr4": (10, None), "cdr1": (5, 12), "cdr2": (1, 10), "cdr3": (5, 38)}
# Fixed value: maximum tokens per sequence (two are special tokens).
MAX_TOKENS = 150


def heavy(df: DataFrame, col: str = "chain") -> DataFrame:
    """B1: heavy chains."""
    return df.filter(F.col(col) == "IGH")


def light(df: DataFrame, col: str = "chain") -> DataFrame:
    """B1: everything that is not IGH, including a missing chain (pandas ``!=`` is true for NaN)."""
    return df.filter((F.col(col) != "IGH") | F.col(col).isNull())


def chain(df: DataFrame, c: str, col: str = "chain") -> DataFrame:
    return df.filter(F.col(col) == c)


def single_heavy_chain(df: DataFrame, col: str = "nr_of_vdj_chains") -> DataFrame:
    """B2: cells with exactly one heavy chain."""
    return df.filter(F.col(col) == 1)


def isotypes(df: DataFrame, col: str = "c_gene", include: Sequence[str] | None = None,
             exclude: Sequence[str] | None = None) -> DataFrame:
    """Include / exclude isotypes; rows with a null isotype go as soon as any list is given."""
    cond = F.col(col).isNotNull() if (include or exclude) else F.lit(True)
    if include:
        cond = cond & F.col(col).isin(*include)
    if exclude:
        cond = cond & ~F.col(col).isin(*exclude)
    return df.filter(cond)


def require(df: DataFrame, cols: Sequence[str], vectors: Sequence[str] = ()) -> DataFrame:
    """Drop rows null in ``cols``; for array columns, drop rows with a null / NaN element."""
    out = df.dropna(subset=list(cols)) if cols else df
    for v in vectors:
        out = out.filter(F.col(v).isNotNull() & vector_complete(v))
    return out


def oas_quality(df: DataFrame, bounds: dict = OAS_BOUNDS) -> DataFrame:
    """Region-length predicate of the corpus build."""
    cond = F.lit(True)
    for col, (lo, hi) in bounds.items():
        n = F.length(F.coalesce(F.col(col), F.lit("")))
        cond = cond & (n >= lo)
        if hi is not None:
            cond = cond & (n <= hi)
    return df.filter(cond)


def max_tokens(df: DataFrame, col: str = "sequence", n: int = MAX_TOKENS) -> DataFrame:
    """Drop sequences longer than ``n`` tokens (residues + 2 specials)."""
    return df.filter(F.length(col) + 2 <= n)


def fill_vectors(df: DataFrame, col: str = "vec", value: float = 0.0) -> DataFrame:
    """Nulls / NaNs inside vectors -> value."""
    return df.withColumn(col, fill_vector(col, value))


def tag(df: DataFrame, **cols) -> DataFrame:
    """Constant tag columns (organ, sample, germline flag...)."""
    for k, v in cols.items():
        df = df.withColumn(k, v if isinstance(v, Column) else F.lit(v))
    return df


def mark_germline(df: DataFrame, is_germline: str = "is_germline", text_cols: Sequence[str] = ("c_gene", "sample_id", "j_gene"),
                  zero_cols: Sequence[str] = ("shm_count",), numeric_cols: Sequence[str] = (),
                  sentinel: float | None = None) -> DataFrame:
    """Germline rows get 'germline' in text columns, 0 mutations, and a
    numeric sentinel (or null + flag by default) in other metadata columns."""
    g = F.col(is_germline)
    for c in text_cols:
        df = df.withColumn(c, F.when(g, F.lit("germline")).otherwise(F.col(c)))
    for c in zero_cols:
        df = df.withColumn(c, F.when(g, F.lit(0)).otherwise(F.col(c)))
    for c in numeric_cols:
        df = df.withColumn(c, F.when(g, F.lit(sentinel).cast("double")).otherwise(F.col(c).cast("double")))
    return df


def as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Metadata to float; unparsable text -> null (ANSI-safe)."""
    for c in cols:
        df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return df


def usable_edges(nodes: DataFrame, edges: DataFrame, group: str = "sample_clonotype", label: str = "label",
                 i: str = "i", j: str | None = None) -> tuple[DataFrame, DataFrame]:
    """B18 (+E7): drop the germline node (largest label of its tree) and edges leaving it.

    With ``j`` the edges that lead to it go too, so that the edges can meet the unfiltered nodes.
    """
    germ = nodes.groupBy(group).agg(F.max(label).alias("_germ"))
    n = nodes.join(germ, group).filter(F.col(label) != F.col("_germ")).drop("_germ")
    e = edges.join(germ, group).filter(F.col(i) != F.col("_germ"))
    if j is not None:
        e = e.filter(F.col(j) != F.col("_germ"))
    return n, e.drop("_germ")


def equal_length(pairs: DataFrame, a: str = "seq_1", b: str = "seq_2") -> DataFrame:
    """Keep pairs whose sequences have equal length."""
    return pairs.filter(F.length(a) == F.length(b))


def allowed_family(df, gene: str = "v_gene", out: str = "v_family_known"):
    """V family if it is on the known list, else null (a 36-row dimension
    table, broadcast: its size is fixed by the list, not by the data)."""
    from clonalyze.functions.regions import KNOWN_V_FAMILIES, gene_family

    dim = df.sparkSession.createDataFrame([(f,) for f in KNOWN_V_FAMILIES], f"{out} string")
    x = df.withColumn("_fam", gene_family(gene))
    return x.join(F.broadcast(dim), x["_fam"] == dim[out], "left").drop("_fam")
