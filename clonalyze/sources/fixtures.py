"""Stand-in repertoire views derived from the driver tables (FIXTURES.md part 2).

Every view is a lazy DataFrame over ``documents`` / ``embeddings`` / ``labels``,
so its size grows with the data. Whole texts are used: a document gives as many
contigs as its residues fill windows. The derivation is narrow (projection, explode);
only ``scored_binary`` joins (labels to documents on the document key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.functions.regions import REGIONS, cat
from clonalyze.session import spread
from clonalyze.sources.tables import table

# Fixed values of the stand-in derivation (must equal the oracle SQL).
WINDOW = 122                # residues of a contig; the last window of a document may be shorter
TOGETHER_SEQUENCES = 20_000     # of a partition whose residues are gathered or sorted by sequence
WINDOW_IDS = 1 << 20        # seq_id = doc_id * WINDOW_IDS + window
SUBSTITUTE_FROM = "ASGTLV"
SUBSTITUTE_TO = "SATGVL"
# (doc_id + window) % 10 -> heavy-chain isotype; 7 is left null on purpose.
ISOTYPE_BY_DIGIT = {0: "IGHM", 1: "IGHD", 2: "IGHG1", 3: "IGHG2B", 4: "IGHG2C", 5: "IGHG3", 6: "IGHA1", 8: "IGHG2", 9: "IGHG4"}
# Lineage stand-in: six nodes per tree, label 6 is the germline root.
LINEAGE_LABELS = 6
LINEAGE_EDGES = [(1, 2), (1, 3), (2, 4), (2, 5), (6, 1)]
# Region boundaries (1-based start, length) inside a window; cdr3 starts at 97.
REGION_SLICES = {"fwr1": (1, 25), "cdr1": (26, 8), "fwr2": (34, 17), "cdr2": (51, 8), "fwr3": (59, 38)}


def amino_acids(text: Column) -> Column:
    """Letters only (non-ASCII removed before upper-casing), then drop B J O U X Z."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "[BJOUXZ]", "")


def _ascii_mod(aa: Column, pos: int, m: int) -> Column:
    return F.ascii(F.substring(aa, pos, 1)) % m


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residue of every document, cut into consecutive windows (the last one short)."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", amino_acids(F.col("text")).alias("aa"))
    # one linear pass over the text; a Generate node also keeps what follows from being
    # pushed below and re-running the document-wide expressions
    cut = F.regexp_extract_all("aa", F.lit(f".{{1,{WINDOW}}}"), F.lit(0))
    return docs.select("doc_id", "source", F.posexplode(cut).alias("win", "aa"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain contig: keys, genes, seven regions (null where the window ends before)."""
    mix = F.col("doc_id") + F.col("win")
    k = (windows(spark, sf_dir)
         .withColumn("k", mix)
         .withColumn("n3", (F.lit(8) + _ascii_mod(F.col("aa"), 3, 8)).cast("int"))
         .withColumn("chain", F.when(F.col("k") % 4 == 1, "IGK").otherwise("IGH")))
    doc, num = F.col("doc_id"), F.col("k")
    # a cell is two windows of a document; the next document, of another sample, repeats its barcode
    bc = F.concat(F.lit("BC"), (doc - doc % 2).cast("string"), F.lit("W"), (F.col("win") - F.col("win") % 2).cast("string"), F.lit("-1"))
    c_heavy = F.create_map(*[x for d, g in ISOTYPE_BY_DIGIT.items() for x in (F.lit(d), F.lit(g))])
    aa = F.col("aa")
    cols = [
        (doc * WINDOW_IDS + F.col("win")).alias("seq_id"),
        F.col("source").alias("sample_id"),
        bc.alias("barcode"),
        F.concat(bc, F.lit("_contig_"), (doc % 2 * 2 + F.col("win") % 2 + 1).cast("string")).alias("contig_id"),
        F.col("chain"),
        F.concat(F.substring("chain", 1, 3), F.lit("V"), (1 + _ascii_mod(aa, 1, 7)).cast("string"), F.lit("-"),
                 (1 + _ascii_mod(aa, 2, 13)).cast("string")).alias("v_gene"),
        F.when((F.col("chain") == "IGH") & (num % 3 != 0), F.concat(F.lit("IGHD"), (1 + num % 4).cast("string"))).alias("d_gene"),
        F.concat(F.substring("chain", 1, 3), F.lit("J"), (1 + _ascii_mod(aa, 4, 4)).cast("string")).alias("j_gene"),
        F.when(F.col("chain") == "IGK", F.lit("IGKC")).otherwise(F.try_element_at(c_heavy, (num % 10).cast("int"))).alias("c_gene"),
        F.concat_ws("_", F.lit("clonotype"), _ascii_mod(aa, 1, 7).cast("string"), _ascii_mod(aa, 2, 13).cast("string"),
                    F.col("n3").cast("string"), _ascii_mod(aa, 5, 11).cast("string")).alias("raw_clonotype_id"),
    ]
    cols += [_some(F.substring(aa, s, n)).alias(r) for r, (s, n) in REGION_SLICES.items()]
    # every residue of the window is in a region; without fwr4 they all belong to cdr3
    tail = num % 50 == 49
    cols += [_some(aa.substr(F.lit(97), F.when(tail, F.lit(WINDOW)).otherwise(F.col("n3")))).alias("cdr3"),
             F.when(~tail, _some(aa.substr(F.lit(97) + F.col("n3"), F.lit(WINDOW)))).alias("fwr4")]
    return k.select(*cols)


def _some(region: Column) -> Column:
    return F.when(region != "", region)


def document_of(seq_id: str) -> Column:
    """The document that a contig is cut from."""
    return F.floor(F.col(seq_id) / WINDOW_IDS).cast("long")


def with_consensus(df: DataFrame) -> DataFrame:
    """Ninth contig key column."""
    return df.withColumn("raw_consensus_id", F.concat("raw_clonotype_id", F.lit("_consensus_1")))


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per heavy chain with the VDJ-table column names (lower case)."""
    c = contigs(spark, sf_dir).filter(F.col("chain") == "IGH")
    # every ninth reference is one residue shorter than its sequence
    middle = F.translate(cat("fwr2", "cdr2", "fwr3"), SUBSTITUTE_FROM, SUBSTITUTE_TO)
    ref = F.concat(F.col("fwr1"), F.col("cdr1"), F.lit("--"),
                   F.when(F.col("seq_id") % 9 == 4, F.expr("substr(translate(fwr2 || cdr2 || fwr3, 'ASGTLV', 'SATGVL'), 2)")).otherwise(middle),
                   F.lit("*"), F.col("cdr3"), F.col("fwr4"))
    return c.select(
        "seq_id", "sample_id",
        F.expr("substr(barcode, 1, length(barcode) - 2)").alias("barcode"),
        "raw_clonotype_id", "v_gene", "j_gene", F.col("c_gene").alias("vdj_cgene"),
        *[F.col(r).alias(f"hc_{r}") for r in REGIONS],
        F.when(F.col("seq_id") % 11 == 0, 2).otherwise(1).cast("int").alias("nr_of_vdj_chains"),
        ref.alias("vdj_ref_aa"),
        (F.col("seq_id") % 15).cast("int").alias("shm_count"),
    )


def vgene_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One V gene reference per heavy chain, with alignment dots (null without the V part)."""
    ref = F.concat(F.col("hc_fwr1"), F.lit(".."), F.col("hc_cdr1"), F.lit("."), F.translate(cat("hc_fwr2", "hc_cdr2", "hc_fwr3"), SUBSTITUTE_FROM, SUBSTITUTE_TO))
    return repertoire(spark, sf_dir).withColumn("vgene_ref_aa", ref)


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six nodes per tree; label 1 is the observed sequence, 6 the germline root."""
    s = (contigs(spark, sf_dir)
         .filter(F.col("chain") == "IGH")
         .select("seq_id", F.concat(*[F.coalesce(r, F.lit("")) for r in REGIONS]).alias("q")))
    n = s.select("seq_id", "q", F.explode(F.sequence(F.lit(1), F.lit(LINEAGE_LABELS))).alias("label"))
    q, lab = F.col("q"), F.col("label")
    at = lab * 10
    mutated = F.concat(q.substr(F.lit(1), at), F.translate(q.substr(at + 1, F.lit(6)), SUBSTITUTE_FROM, SUBSTITUTE_TO),
                       F.expr("substr(q, label * 10 + 7)"))
    seq = F.when(lab == 1, q).when((lab == 5) & (F.col("seq_id") % 4 == 0), F.substring(q, 1, 100)).otherwise(mutated)
    return n.select(F.concat(F.lit("L"), F.col("seq_id").cast("string")).alias("sample_clonotype"),
                    lab.cast("int").alias("label"), seq.alias("network_sequences"))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same five edges in every tree (i = parent, j = child)."""
    edges = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in LINEAGE_EDGES])
    trees = lineage_nodes(spark, sf_dir).filter(F.col("label") == 1).select("sample_clonotype")
    return trees.select("sample_clonotype", F.inline(edges))


def token_labels(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """One row per residue of heavy chains: paratope label and a score.

    With ``together`` the sequences are dealt by ``seq_id`` before they become residues, so that what groups residues
    by it afterwards moves none; a partition gets about ``TOGETHER_SEQUENCES``, which a task sorts in memory.
    """
    q = (contigs(spark, sf_dir).filter(F.col("chain") == "IGH")
         .select("seq_id", F.concat(*[F.coalesce(r, F.lit("")) for r in REGIONS]).alias("q")))
    if together:
        chars = table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
        q = q.repartition(max(spark.sparkContext.defaultParallelism, -(-chars // (WINDOW * TOGETHER_SEQUENCES))), "seq_id")
    z = q.select("seq_id", "q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("p"))
    p = F.col("p")
    paratope = p.between(26, 33) | p.between(51, 58) | (p > 96)
    return z.select(
        "seq_id", p.cast("int").alias("pos"), F.col("q").substr(p, F.lit(1)).alias("aa"),
        F.when(paratope, "P").otherwise("N").alias("label"),
        (((F.col("seq_id") * 31 + p * 17) % 100).cast("double") / 100).alias("prob"),
    )


def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score in [0, 1] (two decimals, so ties occur)."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                    F.round((F.col("n_chars") % 997).cast("double") / 997, 2).alias("score"))


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class labels with a prediction (wrong for every seventh id) and a cluster id."""
    e = table(spark, sf_dir, "embeddings")
    vid, lab = F.col("vec_id"), F.col("label")
    return e.select(vid.alias("id"), lab,
                    F.when(vid % 7 == 0, (lab + 1) % 10).otherwise(lab).cast("int").alias("pred"),
                    (vid % 12).cast("int").alias("cluster"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the float array widened to double."""
    e = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return e.select(F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


VIEWS = {
    "contigs": contigs, "repertoire": repertoire, "lineage_nodes": lineage_nodes, "lineage_edges": lineage_edges,
    "token_labels": token_labels, "scored_binary": scored_binary, "scored_multi": scored_multi, "vectors": vectors,
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every stand-in view for ``spark.sql`` use."""
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
