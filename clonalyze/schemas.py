"""Explicit input schemas (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

# The contig annotation columns read by the scoring jobs.
CONTIG_COLUMNS = ["barcode", "contig_id", "chain", "v_gene", "d_gene", "j_gene", "c_gene", "raw_clonotype_id",
                  "raw_consensus_id", "fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
CONTIG_SCHEMA = T.StructType([T.StructField(c, _S, True) for c in CONTIG_COLUMNS])

CONSENSUS_COLUMNS = ["chain", "v_gene", "fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
CONSENSUS_SCHEMA = T.StructType([T.StructField(c, _S, True) for c in CONSENSUS_COLUMNS])

LABELLED_SCHEMA = T.StructType([T.StructField("sequence", _S, True), T.StructField("label", T.IntegerType(), True)])

# 1-based field positions in a public antibody data unit.
OAS_FIELDS = {"sequence_alignment_aa": 14, "fwr1": 35, "cdr1": 37, "cdr2": 41, "fwr4": 45, "cdr3": 47}
