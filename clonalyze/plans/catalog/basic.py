"""Registered queries: filters, joins, set operations, de-duplication, grouped
counts and column functions (B*, C*, S*, E2-E9, E20, E21, F*, G1, G2, H1-H8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonalyze.functions import regions as R
from clonalyze.operators import aggregates as A
from clonalyze.operators import dedupe as D
from clonalyze.operators import filters as B
from clonalyze.operators import joins as J
from clonalyze.plans.catalog import sqlkit as K
from clonalyze.plans.catalog.views_sql import AA
from clonalyze.plans.catalog.views_sql import with_views as W
from clonalyze.sources import fixtures as fx
from clonalyze.sources.tables import table

ENTRIES: dict = {}


def reg(name, sql=None, views=("contigs",), extra=""):
    def deco(fn):
        ENTRIES[name] = (fn, W(sql, *views, extra=extra) if sql is not None else None)
        return fn
    return deco


C = fx.contigs
REP = fx.repertoire


# ------------------------------------------------------------------ B filters
@reg("B1_heavy_chains", "SELECT seq_id, chain, v_gene FROM contigs WHERE chain = 'IGH'")
def b1_heavy(spark, sf):
    return B.heavy(C(spark, sf)).select("seq_id", "chain", "v_gene")


@reg("B1_light_chains", "SELECT seq_id, chain, v_gene FROM contigs WHERE chain <> 'IGH' OR chain IS NULL")
def b1_light(spark, sf):
    return B.light(C(spark, sf)).select("seq_id", "chain", "v_gene")


@reg("B2_single_heavy_chain", "SELECT seq_id, barcode FROM repertoire WHERE nr_of_vdj_chains = 1", ("repertoire",))
def b2(spark, sf):
    return B.single_heavy_chain(REP(spark, sf)).select("seq_id", "barcode")


@reg("B3_isotype_no_igd_igm", "SELECT seq_id, c_gene FROM contigs WHERE c_gene IS NOT NULL AND c_gene NOT IN ('IGHD', 'IGHM')")
def b3_ex(spark, sf):
    return B.isotypes(C(spark, sf), "c_gene", exclude=["IGHD", "IGHM"]).select("seq_id", "c_gene")


@reg("B3_isotype_only_igm", "SELECT seq_id, c_gene FROM contigs WHERE c_gene IN ('IGHM')")
def b3_in(spark, sf):
    return B.isotypes(C(spark, sf), "c_gene", include=["IGHM"]).select("seq_id", "c_gene")


@reg("B4_require_columns", "SELECT seq_id FROM contigs WHERE fwr4 IS NOT NULL AND c_gene IS NOT NULL AND d_gene IS NOT NULL")
def b4(spark, sf):
    return B.require(C(spark, sf), ["fwr4", "c_gene", "d_gene"]).select("seq_id")


@reg("B5_oas_quality", f"""SELECT seq_id, {K.FULL} AS sequence_alignment_aa FROM contigs
WHERE length(coalesce(fwr1, '')) >= 20 AND length(coalesce(fwr4, '')) >= 10 AND length(coalesce(cdr1, '')) BETWEEN 5 AND 12
  AND length(coalesce(cdr2, '')) BETWEEN 1 AND 10 AND length(coalesce(cdr3, '')) BETWEEN 5 AND 38""")
def b5(spark, sf):
    return B.oas_quality(C(spark, sf)).select("seq_id", R.full_vdj().alias("sequence_alignment_aa"))


@reg("B6_max_tokens", f"SELECT seq_id, {K.FULL} AS sequence FROM contigs WHERE length({K.FULL}) + 2 <= 150")
def b6(spark, sf):
    return B.max_tokens(C(spark, sf).select("seq_id", R.full_vdj().alias("sequence")), "sequence")


@reg("B6_max_tokens_documents", f"SELECT doc_id, aa AS sequence FROM (SELECT doc_id, {AA} AS aa FROM documents) d WHERE length(aa) + 2 <= 150", ())
def b6_documents(spark, sf):
    """Residues of whole documents as one sequence each: most are over the limit."""
    return B.max_tokens(table(spark, sf, "documents").select("doc_id", fx.amino_acids(F.col("text")).alias("sequence")), "sequence")


@reg("B7_full_vdj", f"SELECT seq_id, {K.FULL} AS full_sequence FROM contigs")
def b7(spark, sf):
    return C(spark, sf).select("seq_id", R.full_vdj().alias("full_sequence"))


@reg("B8_v_gene_only", f"SELECT seq_id, {K.VPART} AS v_sequence FROM contigs")
def b8(spark, sf):
    return C(spark, sf).select("seq_id", R.v_gene_part().alias("v_sequence"))


@reg("B9_cdr3_window", f"""SELECT seq_id, CAST(length({K.VPART}) AS INT) AS start_pos,
  CAST(length({K.VPART} || cdr3) AS INT) AS end_pos FROM contigs""")
def b9(spark, sf):
    seq, st, en = R.input_columns("cdr3_from_VDJ")
    return C(spark, sf).select("seq_id", st.alias("start_pos"), en.alias("end_pos"))


_MODE_SQL = " UNION ALL ".join([
    "SELECT seq_id, 'cdr3_only' AS mode, cdr3 AS sequence, CASE WHEN cdr3 IS NOT NULL THEN 0 END AS start_pos, CAST(length(cdr3) AS INT) AS end_pos FROM contigs",
    f"SELECT seq_id, 'v_gene_only', {K.VPART}, CASE WHEN {K.VPART} IS NOT NULL THEN 0 END, CAST(length({K.VPART}) AS INT) FROM contigs",
    f"SELECT seq_id, 'full_VDJ', {K.FULL}, CASE WHEN {K.FULL} IS NOT NULL THEN 0 END, CAST(length({K.FULL}) AS INT) FROM contigs",
    f"SELECT seq_id, 'cdr3_from_VDJ', {K.FULL}, CAST(length({K.VPART}) AS INT), CAST(length({K.VPART} || cdr3) AS INT) FROM contigs"])


@reg("B10_build_input_modes", f"SELECT * FROM ({_MODE_SQL}) m WHERE sequence IS NOT NULL")
def b10(spark, sf):
    c = C(spark, sf)
    specs = []
    for mode in ["cdr3_only", "v_gene_only", "full_VDJ", "cdr3_from_VDJ"]:
        s, st, en = R.input_columns(mode)
        specs.append(F.struct(F.lit(mode).alias("mode"), s.alias("sequence"), st.cast("int").alias("start_pos"), en.alias("end_pos")))
    return c.select("seq_id", F.explode(F.array(*specs)).alias("m")).select("seq_id", "m.*").filter(F.col("sequence").isNotNull())


@reg("B11_fill_vectors", """SELECT seq_id, CAST(len(vec) AS INT) AS dims,
  round(list_sum(list_transform(vec, lambda x: coalesce(CASE WHEN isnan(x) THEN 0 ELSE x END, 0))), 6) AS total FROM vectors""", ("vectors",))
def b11(spark, sf):
    v = B.fill_vectors(fx.vectors(spark, sf), "vec")
    return v.select("seq_id", F.size("vec").cast("int").alias("dims"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@reg("B12_tag_constants", "SELECT seq_id, 'spleen' AS organ, 'S_' || sample_id AS sample_tag, false AS is_germline FROM contigs")
def b12(spark, sf):
    c = C(spark, sf).select("seq_id", "sample_id")
    return B.tag(c, organ="spleen", sample_tag=F.concat(F.lit("S_"), F.col("sample_id")), is_germline=False).drop("sample_id")


_GERM_ROWS = """
SELECT seq_id, sample_id, j_gene, vdj_cgene AS c_gene, shm_count, CAST(seq_id % 7 AS DOUBLE) AS clonotype_frequency, false AS is_germline FROM repertoire
UNION ALL
SELECT min(seq_id) + 1000000000, min(sample_id), min(j_gene), min(vdj_cgene), CAST(NULL AS INT), CAST(NULL AS DOUBLE), true FROM repertoire
GROUP BY sample_id, raw_clonotype_id"""


@reg("B13_B14_mark_germline", f"""SELECT seq_id, CASE WHEN is_germline THEN 'germline' ELSE sample_id END AS sample_id,
  CASE WHEN is_germline THEN 'germline' ELSE j_gene END AS j_gene, CASE WHEN is_germline THEN 'germline' ELSE c_gene END AS c_gene,
  CASE WHEN is_germline THEN 0 ELSE shm_count END AS shm_count,
  CASE WHEN is_germline THEN -10.0 ELSE clonotype_frequency END AS clonotype_frequency, is_germline
FROM ({_GERM_ROWS}) u""", ("repertoire",))
def b13(spark, sf):
    rep = REP(spark, sf)
    obs = rep.select("seq_id", "sample_id", "j_gene", F.col("vdj_cgene").alias("c_gene"), "shm_count",
                     (F.col("seq_id") % 7).cast("double").alias("clonotype_frequency"), F.lit(False).alias("is_germline"))
    germ = rep.groupBy("sample_id", "raw_clonotype_id").agg(
        (F.min("seq_id") + 1000000000).alias("seq_id"), F.min("sample_id").alias("_s"), F.min("j_gene").alias("j_gene"),
        F.min("vdj_cgene").alias("c_gene")).select("seq_id", F.col("_s").alias("sample_id"), "j_gene", "c_gene",
                                                   F.lit(True).alias("is_germline"))
    u = D.stack(obs, germ)
    return B.mark_germline(u, numeric_cols=["clonotype_frequency"], sentinel=-10.0).select(
        "seq_id", "sample_id", "j_gene", "c_gene", "shm_count", "clonotype_frequency", "is_germline")


@reg("B15_cast_double", """SELECT seq_id, TRY_CAST(CASE WHEN seq_id % 5 = 0 THEN 'n/a' ELSE CAST(shm_count AS VARCHAR) END AS DOUBLE) AS shm_count
FROM repertoire""", ("repertoire",))
def b15(spark, sf):
    r = REP(spark, sf).select("seq_id", F.when(F.col("seq_id") % 5 == 0, F.lit("n/a"))
                              .otherwise(F.col("shm_count").cast("string")).alias("shm_count"))
    return B.as_double(r, ["shm_count"])


@reg("B17_equal_length_edges", """SELECT e.sample_clonotype, e.i AS parent, e.j AS child FROM lineage_edges e
JOIN lineage_nodes a ON a.sample_clonotype = e.sample_clonotype AND a.label = e.i
JOIN lineage_nodes b ON b.sample_clonotype = e.sample_clonotype AND b.label = e.j
WHERE length(a.network_sequences) = length(b.network_sequences)""", ("lineage_edges",))
def b17(spark, sf):
    pairs = J.edge_sequences(fx.lineage_nodes(spark, sf), fx.lineage_edges(spark, sf))
    return B.equal_length(pairs).select("sample_clonotype", "parent", "child")


@reg("B18_drop_germline", """SELECT 'node' AS kind, n.sample_clonotype, n.label AS id FROM lineage_nodes n
WHERE n.label <> (SELECT max(label) FROM lineage_nodes m WHERE m.sample_clonotype = n.sample_clonotype)
UNION ALL SELECT 'edge', e.sample_clonotype, e.i * 100 + e.j FROM lineage_edges e
WHERE e.i <> (SELECT max(label) FROM lineage_nodes m WHERE m.sample_clonotype = e.sample_clonotype)""", ("lineage_edges",))
def b18(spark, sf):
    n, e = B.usable_edges(fx.lineage_nodes(spark, sf), fx.lineage_edges(spark, sf))
    return n.select(F.lit("node").alias("kind"), "sample_clonotype", F.col("label").alias("id")).unionByName(
        e.select(F.lit("edge").alias("kind"), "sample_clonotype", (F.col("i") * 100 + F.col("j")).alias("id")))


# ------------------------------------------------------------------ C joins
@reg("C1_null_safe_key_join", """SELECT a.seq_id, a.c_gene, a.d_gene, b.seq_id AS other_id FROM contigs a
JOIN contigs b ON a.sample_id = b.sample_id AND a.barcode = b.barcode AND a.c_gene IS NOT DISTINCT FROM b.c_gene
  AND a.d_gene IS NOT DISTINCT FROM b.d_gene""")
def c1(spark, sf):
    c = C(spark, sf)
    a = c.select("seq_id", "sample_id", "barcode", "c_gene", "d_gene")
    b = c.select(F.col("seq_id").alias("other_id"), "sample_id", "barcode", "c_gene", "d_gene")
    return J.null_safe_join(a, b, ["sample_id", "barcode", "c_gene", "d_gene"]).select("seq_id", "c_gene", "d_gene", "other_id")


@reg("C2_natural_join", f"""SELECT a.seq_id, a.chain, a.d_gene, a.full_len, b.cdr3_len FROM
(SELECT seq_id, chain, d_gene, CAST(length({K.FULL}) AS INT) AS full_len FROM contigs) a JOIN
(SELECT seq_id, chain, d_gene, CAST(length(cdr3) AS INT) AS cdr3_len FROM contigs) b
ON a.seq_id = b.seq_id AND a.chain = b.chain AND a.d_gene IS NOT DISTINCT FROM b.d_gene""")
def c2(spark, sf):
    c = C(spark, sf)
    a = c.select("seq_id", "chain", "d_gene", R.seq_length(R.full_vdj()).alias("full_len"))
    b = c.select("seq_id", "chain", "d_gene", R.seq_length("cdr3").alias("cdr3_len"))
    return J.natural_join(a, b)


@reg("C4_attach_repertoire", """SELECT c.seq_id AS seq_id_x, r.seq_id AS seq_id_y, c.sample_id, r.barcode FROM contigs c
JOIN repertoire r ON c.sample_id = r.sample_id AND split_part(c.barcode, '-', 1) = r.barcode WHERE c.chain = 'IGK'""", ("repertoire",))
def c4(spark, sf):
    emb = B.chain(C(spark, sf), "IGK").select("seq_id", "sample_id", R.bare_barcode("barcode").alias("barcode"))
    rep = REP(spark, sf).select("seq_id", "sample_id", "barcode")
    return J.attach_repertoire(emb, rep).select("seq_id_x", "seq_id_y", "sample_id", "barcode")


@reg("C4_attach_repertoire_barcode_only", """SELECT c.seq_id AS seq_id_x, r.seq_id AS seq_id_y, c.sample_id AS sample_id_x,
  r.sample_id AS sample_id_y, r.barcode FROM contigs c JOIN repertoire r ON split_part(c.barcode, '-', 1) = r.barcode
WHERE c.chain = 'IGK'""", ("repertoire",))
def c4b(spark, sf):
    emb = B.chain(C(spark, sf), "IGK").select("seq_id", "sample_id", R.bare_barcode("barcode").alias("barcode"))
    rep = REP(spark, sf).select("seq_id", "sample_id", "barcode")
    return J.attach_repertoire(emb, rep, barcode_only=True).select("seq_id_x", "seq_id_y", "sample_id_x", "sample_id_y", "barcode")


@reg("C5_enrich_metadata", """SELECT r.seq_id, r.barcode, r.seq_id // 1048576 AS doc_id, l.quality, l.toxic FROM repertoire r LEFT JOIN labels l
ON l.doc_id = r.seq_id // 1048576""", ("repertoire",))
def c5(spark, sf):
    """Metadata that only some documents have."""
    rep = REP(spark, sf).select("seq_id", "barcode", fx.document_of("seq_id").alias("doc_id"))
    return J.enrich(rep, fx.table(spark, sf, "labels"), ["doc_id"]).select("seq_id", "barcode", "doc_id", "quality", "toxic")


@reg("C6_multi_member_clonotypes", f"""SELECT r.seq_id, r.sample_id, r.raw_clonotype_id FROM repertoire r JOIN
(SELECT sample_id, raw_clonotype_id FROM repertoire GROUP BY ALL
 HAVING count(DISTINCT hc_fwr1 || hc_cdr1 || hc_fwr2 || hc_cdr2 || hc_fwr3 || hc_cdr3 || hc_fwr4) > 1) m
ON r.sample_id = m.sample_id AND r.raw_clonotype_id = m.raw_clonotype_id""", ("repertoire",))
def c6(spark, sf):
    rep = REP(spark, sf).withColumn("full", R.full_vdj("hc_"))
    return J.multi_member(rep, ["sample_id", "raw_clonotype_id"], 2, distinct_of="full").select("seq_id", "sample_id", "raw_clonotype_id")


@reg("C7_attach_germline", """SELECT r.seq_id, g.germline FROM repertoire r JOIN
(SELECT sample_id, raw_clonotype_id, min(translate(vdj_ref_aa, '.-*', '')) AS germline FROM repertoire GROUP BY ALL) g
ON r.sample_id = g.sample_id AND r.raw_clonotype_id = g.raw_clonotype_id""", ("repertoire",))
def c7(spark, sf):
    rep = REP(spark, sf)
    germ = rep.groupBy("sample_id", "raw_clonotype_id").agg(F.min(R.strip_gaps("vdj_ref_aa")).alias("germline"))
    return J.attach_germline(germ, rep.select("seq_id", "sample_id", "raw_clonotype_id"), ["sample_id", "raw_clonotype_id"]).select(
        "seq_id", "germline")


@reg("C9_edge_sequences", """SELECT e.sample_clonotype, e.i AS parent, e.j AS child, a.network_sequences AS seq_1, b.network_sequences AS seq_2
FROM lineage_edges e JOIN lineage_nodes a ON a.sample_clonotype = e.sample_clonotype AND a.label = e.i
JOIN lineage_nodes b ON b.sample_clonotype = e.sample_clonotype AND b.label = e.j""", ("lineage_edges",))
def c9(spark, sf):
    return J.edge_sequences(fx.lineage_nodes(spark, sf), fx.lineage_edges(spark, sf))


@reg("C12_join_on_id", f"""SELECT a.seq_id, a.v_gene, length({K.FULL}) AS n FROM contigs a""")
def c12(spark, sf):
    c = C(spark, sf)
    return J.join_on_id(c.select("seq_id", "v_gene"), c.select("seq_id", F.length(R.full_vdj()).alias("n")))


@reg("C15_cluster_germline", """WITH cnt AS (SELECT v_gene AS cluster, raw_clonotype_id AS clonotype, count(*) AS n FROM repertoire GROUP BY ALL),
top AS (SELECT cluster, clonotype FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, clonotype) AS r FROM cnt) x WHERE r = 1),
germ AS (SELECT raw_clonotype_id AS clonotype, min(translate(vdj_ref_aa, '.-*', '')) AS germline FROM repertoire GROUP BY ALL)
SELECT top.cluster, germ.clonotype, germ.germline FROM top JOIN germ ON top.clonotype = germ.clonotype""", ("repertoire",))
def c15(spark, sf):
    rep = REP(spark, sf)
    clusters = rep.select(F.col("v_gene").alias("cluster"), F.col("raw_clonotype_id").alias("clonotype"))
    germ = rep.groupBy(F.col("raw_clonotype_id").alias("clonotype")).agg(F.min(R.strip_gaps("vdj_ref_aa")).alias("germline"))
    return J.cluster_germline(clusters, germ).select("cluster", "clonotype", "germline")


@reg("C16_map_samples", """SELECT c.seq_id, m.sample_id FROM (SELECT seq_id, sample_id AS original_sample_id FROM contigs) c
JOIN (SELECT DISTINCT source AS original_sample_id, 'mouse_' || source AS sample_id FROM documents) m USING (original_sample_id)""")
def c16(spark, sf):
    c = C(spark, sf).select("seq_id", F.col("sample_id").alias("original_sample_id"))
    docs = fx.table(spark, sf, "documents")
    mapping = docs.select(F.col("source").alias("original_sample_id"), F.concat(F.lit("mouse_"), F.col("source")).alias("sample_id"))
    return J.map_samples(c, mapping).select("seq_id", "sample_id")


# ------------------------------------------------------------------ S set operations
@reg("S1_S2_stack_chains", """SELECT chain, CAST(count(*) AS BIGINT) AS n FROM
(SELECT chain FROM contigs WHERE chain = 'IGH' UNION ALL SELECT chain FROM contigs WHERE chain <> 'IGH') u GROUP BY chain""")
def s1(spark, sf):
    c = C(spark, sf).select("seq_id", "chain")
    return D.stack(B.heavy(c), B.light(c)).groupBy("chain").agg(F.count("*").cast("long").alias("n"))


@reg("S3_add_germline_rows", """SELECT seq_id, sample_id, barcode, full_vdj_aa FROM (
SELECT seq_id, sample_id, barcode, hc_fwr1 || hc_cdr1 || hc_fwr2 || hc_cdr2 || hc_fwr3 || hc_cdr3 || hc_fwr4 AS full_vdj_aa FROM repertoire
UNION ALL SELECT -min(seq_id), sample_id, 'germline', min(translate(vdj_ref_aa, '.-*', '')) FROM repertoire GROUP BY sample_id, raw_clonotype_id) u""",
     ("repertoire",))
def s3(spark, sf):
    rep = REP(spark, sf)
    obs = rep.select("seq_id", "sample_id", "barcode", R.full_vdj("hc_").alias("full_vdj_aa"))
    germ = rep.groupBy("sample_id", "raw_clonotype_id").agg((-F.min("seq_id")).alias("seq_id"),
                                                             F.min(R.strip_gaps("vdj_ref_aa")).alias("full_vdj_aa"))
    germ = germ.select("seq_id", "sample_id", F.lit("germline").alias("barcode"), "full_vdj_aa")
    return D.stack(obs, germ).select("seq_id", "sample_id", "barcode", "full_vdj_aa")


@reg("S4_F2_keep_first_sequence", """SELECT seq_id, sample_id, full_vdj_aa FROM (SELECT seq_id, sample_id,
  hc_fwr1 || hc_cdr1 || hc_fwr2 || hc_cdr2 || hc_fwr3 || hc_cdr3 || hc_fwr4 AS full_vdj_aa,
  row_number() OVER (PARTITION BY hc_fwr1 || hc_cdr1 || hc_fwr2 || hc_cdr2 || hc_fwr3 || hc_cdr3 || hc_fwr4 ORDER BY seq_id) AS r
  FROM repertoire) x WHERE r = 1""", ("repertoire",))
def s4(spark, sf):
    rep = REP(spark, sf).select("seq_id", "sample_id", R.full_vdj("hc_").alias("full_vdj_aa"))
    return D.keep_first(rep, ["full_vdj_aa"], "seq_id")


@reg("S4_keep_first_cgene_clonotype", """SELECT seq_id, vdj_cgene, raw_clonotype_id FROM (SELECT seq_id, vdj_cgene, raw_clonotype_id,
  row_number() OVER (PARTITION BY vdj_cgene, raw_clonotype_id ORDER BY seq_id) AS r FROM repertoire) x WHERE r = 1""", ("repertoire",))
def s4b(spark, sf):
    rep = REP(spark, sf).select("seq_id", "vdj_cgene", "raw_clonotype_id")
    return D.keep_first(rep, ["vdj_cgene", "raw_clonotype_id"], "seq_id")


@reg("S5_distinct_gene_pairs", "SELECT DISTINCT v_gene, j_gene FROM contigs")
def s5(spark, sf):
    return D.distinct(C(spark, sf), ["v_gene", "j_gene"])


@reg("S6_union_keep_first", """SELECT barcode, sample_clonotype, src FROM (SELECT *, row_number() OVER (PARTITION BY barcode, sample_clonotype ORDER BY src) AS r FROM (
SELECT barcode, sample_id || '_' || raw_clonotype_id AS sample_clonotype, 'a' || CAST(seq_id AS VARCHAR) AS src FROM repertoire WHERE seq_id // 1048576 IN (SELECT doc_id FROM labels)
UNION ALL SELECT barcode, sample_id || '_' || raw_clonotype_id, 'b' || CAST(seq_id AS VARCHAR) FROM repertoire) u) x WHERE r = 1""", ("repertoire",))
def s6(spark, sf):
    rep = REP(spark, sf)
    key = R.clonotype_key("sample_id", "raw_clonotype_id").alias("sample_clonotype")
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("_doc"))
    a = rep.join(labelled, fx.document_of("seq_id") == F.col("_doc"), "left_semi").select("barcode", key, F.concat(F.lit("a"), F.col("seq_id").cast("string")).alias("src"))
    b = rep.select("barcode", key, F.concat(F.lit("b"), F.col("seq_id").cast("string")).alias("src"))
    return D.keep_first(D.stack(a, b), ["barcode", "sample_clonotype"], "src")


# ------------------------------------------------------------------ E grouped counts
@reg("E2_value_counts_v_gene", "SELECT v_gene, CAST(count(*) AS BIGINT) AS n FROM contigs WHERE v_gene IS NOT NULL GROUP BY v_gene")
def e2(spark, sf):
    return A.value_counts(C(spark, sf), "v_gene")


@reg("E3_representative_barcode", """SELECT sequence, arg_min(barcode, seq_id) AS barcode, CAST(count(*) AS BIGINT) AS n FROM
(SELECT seq_id, barcode, cdr3 AS sequence FROM contigs) t GROUP BY sequence""")
def e3(spark, sf):
    c = C(spark, sf).select("seq_id", "barcode", F.col("cdr3").alias("sequence"))
    return D.representatives(c, "sequence", "barcode")


@reg("E4_E5_expansion", """WITH r AS (SELECT seq_id, sample_id, raw_clonotype_id, hc_cdr3 AS seq FROM repertoire),
u AS (SELECT sample_id, raw_clonotype_id, CAST(count(DISTINCT seq) AS BIGINT) AS unique_sequences FROM r GROUP BY ALL),
f AS (SELECT sample_id, raw_clonotype_id, seq, CAST(count(*) AS BIGINT) AS sequence_frequency FROM r GROUP BY ALL)
SELECT r.seq_id, u.unique_sequences, f.sequence_frequency FROM r JOIN u USING (sample_id, raw_clonotype_id)
JOIN f ON f.sample_id = r.sample_id AND f.raw_clonotype_id = r.raw_clonotype_id AND f.seq IS NOT DISTINCT FROM r.seq""", ("repertoire",))
def e45(spark, sf):
    r = REP(spark, sf).select("seq_id", "sample_id", "raw_clonotype_id", F.col("hc_cdr3").alias("seq"))
    return A.expansion(r, seq="seq").select("seq_id", "unique_sequences", "sequence_frequency")


@reg("E7_germline_labels", "SELECT sample_clonotype, max(label) AS germline_label FROM lineage_nodes GROUP BY ALL", ("lineage_nodes",))
def e7(spark, sf):
    return A.germline_labels(fx.lineage_nodes(spark, sf))


@reg("E8_H17_normalise", """SELECT seq_id, round(least((shm_count - lo) / nullif(hi - lo, 0), 1.0), 6) AS shm_norm FROM repertoire,
(SELECT CAST(min(shm_count) AS DOUBLE) AS lo, CAST(max(shm_count) AS DOUBLE) AS hi FROM repertoire) m""", ("repertoire",))
def e8(spark, sf):
    r = REP(spark, sf).select("seq_id", "shm_count")
    return A.normalise(r, "shm_count", out="shm_norm").select("seq_id", F.round("shm_norm", 6).alias("shm_norm"))


@reg("E9_undersample", """WITH r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM scored_binary)
SELECT id, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scored_binary GROUP BY label) c)""", ("scored_binary",))
def e9(spark, sf):
    return D.undersample(fx.scored_binary(spark, sf), "label", "id").select("id", "label")


@reg("E20_histogram_cdr3_length", """SELECT chain AS model, CAST(floor(length(cdr3) / 1.0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n,
  round(floor(length(cdr3) / 1.0) * 1.0, 6) AS bin_start FROM contigs WHERE cdr3 IS NOT NULL GROUP BY ALL""")
def e20(spark, sf):
    c = C(spark, sf).select(F.col("chain").alias("model"), F.length("cdr3").alias("cdr3_len"))
    return A.histogram(c, "cdr3_len", 1.0).select("model", "bin", "n", "bin_start")


@reg("E21_best_by", """SELECT sample_id, first(k ORDER BY n3 DESC, k) AS k, max(n3) AS score FROM
(SELECT sample_id, CAST(seq_id AS BIGINT) AS k, CAST(length(cdr3) AS INT) AS n3 FROM contigs) t GROUP BY sample_id""")
def e21(spark, sf):
    c = C(spark, sf).select("sample_id", F.col("seq_id").alias("k"), R.seq_length("cdr3").alias("score"))
    return A.best_by(c, "score", "k", by=["sample_id"]).select("sample_id", "k", "score")


# ------------------------------------------------------------------ F ranking
@reg("F3_top_v_genes", """SELECT v_gene, CAST(count(*) AS BIGINT) AS n FROM contigs WHERE v_gene IS NOT NULL GROUP BY v_gene
ORDER BY n DESC, v_gene LIMIT 10""")
def f3(spark, sf):
    return D.top_groups(C(spark, sf), "v_gene", 10)


@reg("F3_mode_v_gene_per_sample", """WITH c AS (SELECT sample_id, v_gene, count(*) AS n FROM contigs GROUP BY ALL)
SELECT sample_id, min(v_gene) AS v_gene, CAST(max(n) AS BIGINT) AS n FROM c WHERE n = (SELECT max(n) FROM c c2 WHERE c2.sample_id = c.sample_id)
GROUP BY sample_id""")
def f3b(spark, sf):
    return D.mode_of(C(spark, sf), "sample_id", "v_gene")


@reg("F4_factorize_clonotypes", """WITH f AS (SELECT raw_clonotype_id, min(seq_id) AS first FROM contigs GROUP BY ALL),
codes AS (SELECT raw_clonotype_id, CAST(row_number() OVER (ORDER BY first, raw_clonotype_id) - 1 AS INT) AS raw_clonotype_id_code FROM f)
SELECT c.seq_id, codes.raw_clonotype_id_code FROM contigs c JOIN codes USING (raw_clonotype_id)""")
def f4(spark, sf):
    return D.factorize(C(spark, sf).select("seq_id", "raw_clonotype_id"), "raw_clonotype_id").select("seq_id", "raw_clonotype_id_code")


@reg("F5_head_per_class", """SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS r
FROM scored_multi) x WHERE r <= 5""", ("scored_multi",))
def f5(spark, sf):
    return D.head_per(fx.scored_multi(spark, sf), "label", 5, "id").select("id", "label")


@reg("F6_rank_within_sample", """SELECT seq_id, sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY cdr3 NULLS FIRST, seq_id) AS BIGINT) AS rank
FROM contigs""")
def f6(spark, sf):
    c = C(spark, sf).select("seq_id", "sample_id", "cdr3")
    return D.rank_within(c, "sample_id", ["cdr3", "seq_id"], out="rank").select("seq_id", "sample_id", "rank")


@reg("F6_windowed_counts", """SELECT seq_id, CAST(count(*) OVER (PARTITION BY sample_id, cdr3) AS BIGINT) AS same_cdr3,
  CAST(count(*) OVER (PARTITION BY d_gene) AS BIGINT) AS same_d_gene FROM contigs""")
def f6w(spark, sf):
    """Windowed counts as aggregate and null-safe join; cdr3 and d_gene may be null."""
    c = C(spark, sf).select("seq_id", "sample_id", "cdr3", "d_gene")
    out = A.attach_count(A.attach_count(c, ["sample_id", "cdr3"], "same_cdr3"), "d_gene", "same_d_gene")
    return out.select("seq_id", "same_cdr3", "same_d_gene")


@reg("F5_head_per_nullable_class", """SELECT seq_id, d_gene FROM (SELECT seq_id, d_gene, row_number() OVER (PARTITION BY d_gene ORDER BY seq_id) AS r
FROM contigs) x WHERE r <= 5""")
def f5n(spark, sf):
    return D.head_per(C(spark, sf).select("seq_id", "d_gene"), "d_gene", 5).select("seq_id", "d_gene")


@reg("E9_undersample_nullable_class", """WITH r AS (SELECT seq_id, d_gene, row_number() OVER (PARTITION BY d_gene ORDER BY seq_id) AS rn FROM contigs)
SELECT seq_id, d_gene FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM contigs GROUP BY d_gene) c)""")
def e9n(spark, sf):
    return D.undersample(C(spark, sf).select("seq_id", "d_gene"), "d_gene").select("seq_id", "d_gene")


# ------------------------------------------------------------------ G sort / head
@reg("G1_sort_by_sample", "SELECT seq_id, sample_id FROM contigs ORDER BY sample_id, seq_id")
def g1(spark, sf):
    return C(spark, sf).select("seq_id", "sample_id").orderBy("sample_id", "seq_id")


@reg("G2_head", "SELECT seq_id, sample_id FROM contigs ORDER BY seq_id LIMIT 25")
def g2(spark, sf):
    return D.head(C(spark, sf).select("seq_id", "sample_id"), 25, "seq_id")


# ------------------------------------------------------------------ H column functions
@reg("H1_H8_column_functions", """SELECT seq_id, split_part(v_gene, '-', 1) AS v_family, split_part(barcode, '-', 1) AS bare_barcode,
  {iso} AS isotype, sample_id || '_' || raw_clonotype_id AS clonotype_key,
  array_to_string(string_split(cdr3, ''), ' ') AS spaced_cdr3, CAST(length(cdr3) AS INT) AS cdr3_len
FROM contigs""".replace("{iso}", K.isotype("c_gene")))
def h1(spark, sf):
    c = C(spark, sf)
    return c.select("seq_id", R.gene_family("v_gene").alias("v_family"), R.bare_barcode("barcode").alias("bare_barcode"),
                    R.collapse_isotype("c_gene").alias("isotype"),
                    R.clonotype_key("sample_id", "raw_clonotype_id").alias("clonotype_key"),
                    R.spaced("cdr3").alias("spaced_cdr3"), R.seq_length("cdr3").alias("cdr3_len"))


@reg("H6_H8_strip_and_diff", """SELECT seq_id, g AS germline, array_to_string(list_transform(list_filter(range(1, length(q) + 1),
  lambda i: substr(q, i, 1) <> substr(g, i, 1)), lambda x: CAST(x AS VARCHAR)), ',') AS diff, CAST(len(list_filter(range(1, length(q) + 1),
  lambda i: substr(q, i, 1) = substr(g, i, 1))) AS INT) AS n_same
FROM (SELECT seq_id, hc_fwr1 || hc_cdr1 || hc_fwr2 || hc_cdr2 || hc_fwr3 || hc_cdr3 || hc_fwr4 AS q,
  translate(vdj_ref_aa, '.-*', '') AS g FROM repertoire) t WHERE length(q) = length(g)""", ("repertoire",))
def h6(spark, sf):
    r = REP(spark, sf).select("seq_id", R.full_vdj("hc_").alias("q"), R.strip_gaps("vdj_ref_aa").alias("g"))
    r = r.filter(F.length("q") == F.length("g"))
    return r.select("seq_id", F.col("g").alias("germline"),
                    F.array_join(F.transform(R.diff_positions("q", "g"), lambda x: x.cast("string")), ",").alias("diff"),
                    F.size(R.same_positions("q", "g")).cast("int").alias("n_same"))
