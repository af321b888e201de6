"""Sequence vectors: providers (U2), pooling (E18) and ensembles.

Built-in provider: one-hot residues. Average pooling of one-hot vectors is the
residue composition of the window, computed as 20 counting expressions on the
window substring - a narrow projection, no explode and no shuffle. ``first`` /
``last`` are the one-hot of the window's first / last residue.

Token vectors from an external model (one row per (sequence, position) with an
``array<double>``) are pooled with ``Summarizer.mean``, a JVM-side partial
aggregation over vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.residues import ALPHABET
from clonalyze.session import cut_lineage

POOLING = ["average", "first", "last"]
SIF_A = 1e-3                    # k-mers of about this share or more are weighed down
W2V_TOKENS = 5_000_000          # k-mers a Word2Vec partition trains on
TABLE_BYTES = 64 << 20          # a k-mer table up to this size goes to every task, a larger one is joined


def window_text(seq: Column, start: Column, end: Column) -> Column:
    """Residues in the 0-based half-open window [start, end)."""
    return F.substring(seq, start + 1, end - start)


def onehot_pool(w: Column, how: str = "average") -> Column:
    """U2 + E18 for the one-hot provider over window text ``w``: a 20-wide
    ``array<double>`` (alphabetical); null for an empty window.

    Pass ``w`` as a column of its own (see ``with_window``) so the 20 counting
    expressions share it instead of each re-deriving the window.
    """
    n = F.length(w)
    letters = F.array(*[F.lit(a) for a in ALPHABET])
    if how == "average":
        # one higher-order expression: small generated code whatever the alphabet size
        return F.when(n > 0, F.transform(letters, lambda a: (F.size(F.split(w, a)) - 1).cast("double") / n))
    if how in ("first", "last"):
        ch = F.substring(w, 1, 1) if how == "first" else F.substring(w, -1, 1)
        return F.when(n > 0, F.transform(letters, lambda a: F.when(ch == a, 1.0).otherwise(0.0)))
    raise ValueError(f"pooling {how!r} not one of {POOLING}")


def with_window(df: DataFrame, seq: Column, start: Column, end: Column, keep, name: str = "_w") -> DataFrame:
    """Project ``keep`` plus the window text as column ``name``."""
    return df.select(*keep, window_text(seq, start, end).alias(name))


def pool_tokens(tokens: DataFrame, keys: Sequence[str], vec: str = "vec", how: str = "average", pos: str = "pos") -> DataFrame:
    """E18 for token vectors: average = element-wise mean (Summarizer, partial
    aggregation); first / last = vector at the smallest / largest position."""
    keys = list(keys)
    if how == "average":
        v = tokens.withColumn("_v", array_to_vector(F.col(vec)))
        return v.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(vec))
    pick = F.min_by if how == "first" else F.max_by
    return tokens.groupBy(*keys).agg(pick(F.col(vec), F.col(pos)).alias(vec))


def ensemble_vectors(dfs: Sequence[DataFrame] | DataFrame, keys: Sequence[str], vec: str | Sequence[str] = "vec", dims: int = len(ALPHABET)) -> DataFrame:
    """E19 (vectors): element-wise mean of several models' vectors of the same rows.

    ``dfs`` is a table a model, or one table with a vector column a model (``vec`` names them, all of ``dims`` numbers). The
    latter is read once, and its sums are plain numbers of a hash aggregation. Null vectors take no part.
    """
    keys = list(keys)
    if isinstance(dfs, DataFrame):
        rows = dfs.select(*keys, F.explode(F.array(*vec)).alias("_v"))
        means = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), *[F.avg(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(dims)])
        return means.select(*keys, F.when(F.col("_n") > 0, F.array(*[f"_{i}" for i in range(dims)])).alias("vec"))
    u = dfs[0].select(*keys, vec)
    for d in dfs[1:]:
        u = u.unionByName(d.select(*keys, vec))
    return pool_tokens(u, keys, vec, "average")


def mean_of(*cols: str) -> Column:
    """E19 where the models' probabilities stand on the same row: their mean, without a shuffle."""
    return sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)


def ensemble_probs(dfs: Sequence[DataFrame], keys: Sequence[str] = ("seq_id", "pos", "aa")) -> DataFrame:
    """E19 (probabilities): mean probability per (sequence, position, residue)."""
    keys = list(keys)
    u = dfs[0].select(*keys, "prob")
    for d in dfs[1:]:
        u = u.unionByName(d.select(*keys, "prob"))
    return u.groupBy(*keys).agg(F.avg("prob").alias("prob"))


def kmers(seq: str | Column, k: int) -> Column:
    """Overlapping k-mers of a sequence (none if it is shorter than ``k``; null stays null)."""
    c = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(c) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, k))) \
        .when(c.isNotNull(), F.array().cast("array<string>"))


def kmer_weights(df: DataFrame, seq: str = "sequence", k: int = 3, a: float = SIF_A) -> DataFrame:
    """U2 ``pooler``, weights: (kmer, n, weight = a / (a + share of the k-mer)) over all sequences.

    Counted with map-side combine; as many rows as there are different k-mers.
    """
    counts = cut_lineage(df.select(F.explode(kmers(seq, k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0             # one number
    return counts.select("kmer", "n", (F.lit(a) / (F.lit(a) + F.col("n") / F.lit(float(total)))).alias("weight"))


def weighted_pool(df: DataFrame, table: DataFrame, seq: str = "sequence", id: str = "seq_id", k: int = 3, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, vec): sum of weight times vector over a sequence's k-mers, divided by their number.

    ``table`` holds (kmer, weight, vec). K-mers without a row count as zero vectors; a sequence without k-mers is null.
    ``id`` is unique. A table of at most ``table_bytes`` is read by every task; a larger one is joined to the exploded
    k-mers, summed with map-side combine.
    """
    one = table.select("vec").first()
    dims = len(one[0]) if one else 0
    rows = df.select(id, F.col(seq).alias("_s"))
    if table.count() * 8 * max(dims, 1) <= table_bytes:
        held = table.select("kmer", "weight", "vec").collect()      # checked size
        index = {r.kmer: i for i, r in enumerate(held)}
        matrix = np.vstack([np.zeros((0, dims))] + [np.asarray(r.vec) * r.weight for r in held] + [np.zeros(dims)])

        @F.pandas_udf("array<double>")
        def pooled(s: pd.Series) -> pd.Series:
            none = len(index)
            return pd.Series([matrix[[index.get(x[i:i + k], none) for i in range(len(x) - k + 1)]].sum(axis=0) / (len(x) - k + 1)
                              if x is not None and len(x) >= k else None for x in s], dtype=object)

        return rows.select(id, pooled("_s").alias("vec"))
    hits = rows.select(id, F.explode(kmers("_s", k)).alias("kmer")).groupBy(id, "kmer").agg(F.count(F.lit(1)).alias("_n")).join(table, "kmer")
    sums = hits.groupBy(id).agg(vector_to_array(Summarizer.sum(array_to_vector(F.transform("vec", lambda x: x * F.col("weight") * F.col("_n"))))).alias("_v"))
    n = F.length("_s") - k + 1
    zero = F.array_repeat(F.lit(0.0), dims)
    return (rows.join(sums.withColumnRenamed(id, "_id"), F.col(id) == F.col("_id"), "left")
            .select(id, F.when(n > 0, F.transform(F.coalesce("_v", zero), lambda x: x / n)).alias("vec")))


def second_moment(df: DataFrame, vec: str = "vec") -> np.ndarray:
    """Sum of the vectors' outer products: one square of the dimensions from each task, added by row in Spark.

    Null vectors take no part. The driver gets dimensions squared numbers, whatever the number of rows.
    """
    def partial(batches):
        total = None
        for b in batches:
            if len(b):
                x = np.vstack(b["vec"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    part = df.filter(F.col(vec).isNotNull()).select(F.col(vec).alias("vec")).mapInPandas(partial, "i int, v array<double>")
    rows = part.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).orderBy("i").collect()
    return np.array([r.v for r in rows])


def remove_common(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors without their part along the leading axis of all rows (first eigenvector of the uncentred second moment)."""
    moment = second_moment(df, vec)
    if not len(moment):
        return df
    axis = np.linalg.eigh(moment)[1][:, -1]
    u = F.array(*[F.lit(float(x)) for x in axis])
    along = F.aggregate(F.zip_with(vec, u, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cols = [c for c in df.columns if c != vec]
    # the length along the axis is a column of its own, computed once a row
    return df.select(*cols, vec, along.alias("_along")).select(*cols, F.zip_with(vec, u, lambda x, y: x - F.col("_along") * y).alias(vec))


def pooler(df: DataFrame, table: DataFrame, seq: str = "sequence", id: str = "seq_id", k: int = 3) -> DataFrame:
    """U2 ``pooler`` (third kind of pooling): inverse-frequency weighted mean of k-mer vectors, common axis removed.

    ``table`` holds (kmer, vec), e.g. Word2Vec's ``getVectors``; weights are counted over ``df``.
    """
    weighed = kmer_weights(df, seq, k).join(table.select("kmer", "vec"), "kmer").select("kmer", "weight", "vec")
    return remove_common(cut_lineage(weighted_pool(df, cut_lineage(weighed), seq, id, k)))


def kmer_word2vec(df: DataFrame, seq: str = "sequence", k: int = 3, size: int = 32, seed: int = 42):
    """U2 (learned): ``Word2Vec`` over overlapping k-mers; returns (model, vectors)."""
    from pyspark.ml.feature import Word2Vec

    words = df.withColumn("_kmers", F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(F.col(seq), i, k)))
    # counted from the lengths: a pass over the texts that cuts no k-mers
    tokens = df.agg(F.sum(F.greatest(F.length(seq) - k + 1, F.lit(1)).cast("long"))).first()[0] or 0
    parts = max(1, -(-tokens // W2V_TOKENS))     # every partition trains a model of its own that is averaged: no more than the tokens need
    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, numPartitions=parts, inputCol="_kmers", outputCol="_w2v").fit(words)
    out = model.transform(words).withColumn("vec", vector_to_array("_w2v")).drop("_kmers", "_w2v")
    return model, out


def long_form(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, dim, value): a vector table in long form (export / comparison).

    ``posexplode_outer`` + a filter on the generated column: a plain posexplode
    makes Catalyst infer ``size(vec) > 0`` and push it below the projections,
    re-deriving the vector in an extra (non-codegen) filter.
    """
    x = df.select(*keys, F.posexplode_outer(vec).alias("dim", "value")).filter(F.col("dim").isNotNull())
    return x.withColumn("dim", F.col("dim").cast("int"))
