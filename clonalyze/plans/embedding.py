"""Embedding jobs: vectors for every mode (J5) and for germline references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.regions import input_columns, strip_gaps
from clonalyze.operators.dedupe import keep_first
from clonalyze.operators.embed import onehot_pool, with_window

EMBED_MODES = ["cdr3_only", "v_gene_only", "full_VDJ", "cdr3_from_VDJ"]


def embed(contigs: DataFrame, modes: Sequence[str] = EMBED_MODES, how: str = "average",
          keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """(keys, mode, vec) for every mode; rows with a null mode input are dropped.

    One pass over the contigs: the modes are an exploded array of structs, the
    vector a projection.
    """
    specs = []
    for mode in modes:
        seq, start, end = input_columns(mode)
        specs.append(F.struct(F.lit(mode).alias("mode"), seq.alias("s"), start.alias("st"), end.alias("en")))
    x = contigs.select(*keys, F.explode(F.array(*specs)).alias("_m")).select(*keys, "_m.*").filter(F.col("s").isNotNull())
    x = with_window(x, F.col("s"), F.col("st"), F.col("en"), [*keys, "mode"])
    return x.select(*keys, "mode", onehot_pool(F.col("_w"), how).alias("vec"))


def unrecombined_references(refs: DataFrame, reference: str = "vgene_ref_aa") -> DataFrame:
    """J8 (un-recombined): V gene references without alignment dots, one row per (c_gene, clonotype,
    reference) keeping the first; rows without a reference are left out."""
    g = refs.select("seq_id", "sample_id", "barcode", F.col("vdj_cgene").alias("c_gene"), "raw_clonotype_id",
                    F.replace(F.col(reference), F.lit("."), F.lit("")).alias("germline"))
    return keep_first(g.filter(F.col("germline").isNotNull()), ["c_gene", "raw_clonotype_id", "germline"], "seq_id")


def unrecombined_embed(refs: DataFrame, how: str = "average", reference: str = "vgene_ref_aa") -> DataFrame:
    """J8 (un-recombined): the references' vectors of the one-hot provider."""
    g = unrecombined_references(refs, reference)
    return g.select("seq_id", "c_gene", "raw_clonotype_id", onehot_pool(F.col("germline"), how).alias("vec"))


def germline_embed(rep: DataFrame, how: str = "average") -> DataFrame:
    """Germline references without gaps (H6), one row per (c_gene, clonotype,
    reference) keeping the first (F2), embedded with the one-hot provider."""
    g = rep.select("seq_id", F.col("vdj_cgene").alias("c_gene"), "raw_clonotype_id", strip_gaps("vdj_ref_aa").alias("germline"))
    g = keep_first(g.filter(F.col("germline").isNotNull()), ["c_gene", "raw_clonotype_id", "germline"], "seq_id")
    return g.select("seq_id", "c_gene", "raw_clonotype_id", onehot_pool(F.col("germline"), how).alias("vec"))
