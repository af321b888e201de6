"""DuckDB text of the stand-in views, inlined as CTEs in every oracle query.

Only the driver tables are registered on the oracle side, so each oracle query
carries the CTEs it needs (``with_views``), dependencies first.
"""

from __future__ import annotations

AA = ("regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g')")

_CONTIGS = f"""
contigs_b AS (SELECT doc_id, source, {AA} AS aa FROM documents),
contigs_w AS (SELECT doc_id, source, unnest(regexp_extract_all(aa, '.{{1,122}}')) AS aa,
  CAST(unnest(range(0, len(regexp_extract_all(aa, '.{{1,122}}')))) AS BIGINT) AS win FROM contigs_b),
contigs_k AS (SELECT *, doc_id + win AS k, CAST(8 + ascii(substr(aa,3,1)) % 8 AS INT) AS n3,
  CASE WHEN (doc_id + win) % 4 = 1 THEN 'IGK' ELSE 'IGH' END AS chain,
  'BC' || CAST(doc_id - doc_id % 2 AS VARCHAR) || 'W' || CAST(win - win % 2 AS VARCHAR) || '-1' AS bc FROM contigs_w),
contigs AS (SELECT doc_id * 1048576 + win AS seq_id, source AS sample_id,
  bc AS barcode, bc || '_contig_' || CAST(doc_id % 2 * 2 + win % 2 + 1 AS VARCHAR) AS contig_id,
  chain,
  substr(chain,1,3) || 'V' || CAST(1 + ascii(substr(aa,1,1)) % 7 AS VARCHAR) || '-' || CAST(1 + ascii(substr(aa,2,1)) % 13 AS VARCHAR) AS v_gene,
  CASE WHEN chain = 'IGH' AND k % 3 <> 0 THEN 'IGHD' || CAST(1 + k % 4 AS VARCHAR) END AS d_gene,
  substr(chain,1,3) || 'J' || CAST(1 + ascii(substr(aa,4,1)) % 4 AS VARCHAR) AS j_gene,
  CASE WHEN chain = 'IGK' THEN 'IGKC' ELSE CASE k % 10 WHEN 0 THEN 'IGHM' WHEN 1 THEN 'IGHD' WHEN 2 THEN 'IGHG1'
    WHEN 3 THEN 'IGHG2B' WHEN 4 THEN 'IGHG2C' WHEN 5 THEN 'IGHG3' WHEN 6 THEN 'IGHA1' WHEN 8 THEN 'IGHG2' WHEN 9 THEN 'IGHG4' END END AS c_gene,
  'clonotype_' || CAST(ascii(substr(aa,1,1)) % 7 AS VARCHAR) || '_' || CAST(ascii(substr(aa,2,1)) % 13 AS VARCHAR) || '_' || CAST(n3 AS VARCHAR)
    || '_' || CAST(ascii(substr(aa,5,1)) % 11 AS VARCHAR) AS raw_clonotype_id,
  nullif(substr(aa,1,25), '') AS fwr1, nullif(substr(aa,26,8), '') AS cdr1, nullif(substr(aa,34,17), '') AS fwr2,
  nullif(substr(aa,51,8), '') AS cdr2, nullif(substr(aa,59,38), '') AS fwr3,
  nullif(CASE WHEN k % 50 = 49 THEN substr(aa,97) ELSE substr(aa,97,n3) END, '') AS cdr3,
  CASE WHEN k % 50 <> 49 THEN nullif(substr(aa, 97 + n3), '') END AS fwr4 FROM contigs_k)"""

_REPERTOIRE = """
repertoire AS (SELECT seq_id, sample_id, substr(barcode, 1, length(barcode) - 2) AS barcode, raw_clonotype_id, v_gene, j_gene, c_gene AS vdj_cgene,
  fwr1 AS hc_fwr1, cdr1 AS hc_cdr1, fwr2 AS hc_fwr2, cdr2 AS hc_cdr2, fwr3 AS hc_fwr3, cdr3 AS hc_cdr3, fwr4 AS hc_fwr4,
  CAST(CASE WHEN seq_id % 11 = 0 THEN 2 ELSE 1 END AS INT) AS nr_of_vdj_chains,
  fwr1 || cdr1 || '--' || substr(translate(fwr2 || cdr2 || fwr3, 'ASGTLV', 'SATGVL'), CASE WHEN seq_id % 9 = 4 THEN 2 ELSE 1 END) || '*' || cdr3 || fwr4 AS vdj_ref_aa,
  CAST(seq_id % 15 AS INT) AS shm_count
FROM contigs WHERE chain = 'IGH')"""

_VGENE_REFERENCES = """
vgene_references AS (SELECT *, hc_fwr1 || '..' || hc_cdr1 || '.' || translate(hc_fwr2 || hc_cdr2 || hc_fwr3, 'ASGTLV', 'SATGVL') AS vgene_ref_aa FROM repertoire)"""

_LINEAGE_NODES = """
lineage_s AS (SELECT seq_id, concat(fwr1, cdr1, fwr2, cdr2, fwr3, cdr3, fwr4) AS q FROM contigs WHERE chain = 'IGH'),
lineage_n AS (SELECT 1 AS label UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6),
lineage_nodes AS (SELECT 'L' || CAST(seq_id AS VARCHAR) AS sample_clonotype, CAST(label AS INT) AS label,
  CASE WHEN label = 1 THEN q
       WHEN label = 5 AND seq_id % 4 = 0 THEN substr(q, 1, 100)
       ELSE substr(q, 1, 10*label) || translate(substr(q, 10*label + 1, 6), 'ASGTLV', 'SATGVL') || substr(q, 10*label + 7) END AS network_sequences
FROM lineage_s CROSS JOIN lineage_n)"""

_LINEAGE_EDGES = """
lineage_e AS (SELECT 1 AS i, 2 AS j UNION ALL SELECT 1, 3 UNION ALL SELECT 2, 4 UNION ALL SELECT 2, 5 UNION ALL SELECT 6, 1),
lineage_edges AS (SELECT c.sample_clonotype, CAST(e.i AS INT) AS i, CAST(e.j AS INT) AS j
  FROM (SELECT DISTINCT sample_clonotype FROM lineage_nodes) c CROSS JOIN lineage_e e)"""

_TOKEN_LABELS = """
token_labels AS (SELECT seq_id, CAST(p AS INT) AS pos, substr(q, CAST(p AS INT), 1) AS aa,
  CASE WHEN p BETWEEN 26 AND 33 OR p BETWEEN 51 AND 58 OR p > 96 THEN 'P' ELSE 'N' END AS label,
  CAST((seq_id * 31 + p * 17) % 100 AS DOUBLE) / 100 AS prob
FROM (SELECT seq_id, q, unnest(range(1, length(q) + 1)) AS p FROM (SELECT seq_id, concat(fwr1, cdr1, fwr2, cdr2, fwr3, cdr3, fwr4) AS q FROM contigs WHERE chain = 'IGH') a) z)"""

_SCORED_BINARY = """
scored_binary AS (SELECT l.doc_id AS id, l.quality AS label, round(CAST(d.n_chars % 997 AS DOUBLE) / 997, 2) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

_SCORED_MULTI = """
scored_multi AS (SELECT vec_id AS id, label, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS pred,
  CAST(vec_id % 12 AS INT) AS cluster FROM embeddings)"""

_VECTORS = """
vectors AS (SELECT vec_id AS seq_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""

VIEW_SQL = {
    "contigs": ((), _CONTIGS),
    "repertoire": (("contigs",), _REPERTOIRE),
    "vgene_references": (("repertoire",), _VGENE_REFERENCES),
    "lineage_nodes": (("contigs",), _LINEAGE_NODES),
    "lineage_edges": (("lineage_nodes",), _LINEAGE_EDGES),
    "token_labels": (("contigs",), _TOKEN_LABELS),
    "scored_binary": ((), _SCORED_BINARY),
    "scored_multi": ((), _SCORED_MULTI),
    "vectors": ((), _VECTORS),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: str = "") -> str:
    """``WITH <views>[, extra] <body>``; ``extra`` holds query-specific CTEs."""
    parts = [VIEW_SQL[n][1].strip() for n in _order(names)]
    if extra.strip():
        parts.append(extra.strip().rstrip(","))
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        # the body's own CTEs continue the list
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
