"""Column expressions over gene names and sequence regions (no UDFs).

Everything here returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the analysed workflow:
# the seven annotated regions of a variable domain, in sequence order.
REGIONS = ["fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
# Isotype subclasses collapsed to their class (default list).
IGG_SUBTYPES = ["IGHG1", "IGHG2", "IGHG2B", "IGHG2C", "IGHG3", "IGHG4"]
IGA_SUBTYPES = ["IGHA1", "IGHA2"]
# Characters removed from germline reference sequences.
GAP_CHARS = ".-*"
# Modes of input construction for scoring and embedding.
MODES = ["general", "cdr3_only", "v_gene_only", "full_VDJ", "cdr3_from_VDJ"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cat(*cols) -> Column:
    """Null-propagating concatenation (a null region gives a null sequence)."""
    return F.concat(*[_c(c) for c in cols])


def gene_family(c) -> Column:
    """H1: text before the first ``-`` (``IGHV1-2`` -> ``IGHV1``); null stays null."""
    return F.substring_index(_c(c), "-", 1)


def bare_barcode(c) -> Column:
    """H2: barcode without its ``-1`` suffix."""
    return F.substring_index(_c(c), "-", 1)


def collapse_isotype(c, igg=IGG_SUBTYPES, iga=IGA_SUBTYPES) -> Column:
    """H3: subclasses -> IGHG / IGHA, other values unchanged."""
    c = _c(c)
    return F.when(c.isin(*igg), F.lit("IGHG")).when(c.isin(*iga), F.lit("IGHA")).otherwise(c)


def clonotype_key(sample, clonotype) -> Column:
    """H4: ``sample_id || '_' || raw_clonotype_id``."""
    return F.concat(_c(sample), F.lit("_"), _c(clonotype))


def spaced(c) -> Column:
    """H5: residues separated by single spaces (input form of residue models)."""
    return F.array_join(F.split(_c(c), ""), " ")


def strip_gaps(c, chars: str = GAP_CHARS) -> Column:
    """H6: drop alignment gap and stop characters."""
    return F.translate(_c(c), chars, "")


def seq_length(c) -> Column:
    """H7: length as INT."""
    return F.length(_c(c)).cast("int")


def diff_positions(a, b) -> Column:
    """H8: 1-based positions where two equal-length strings differ."""
    a, b = _c(a), _c(b)
    return F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))


def same_positions(a, b) -> Column:
    """H8: 1-based positions where two equal-length strings agree."""
    a, b = _c(a), _c(b)
    return F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, 1) == F.substring(b, i, 1))


def full_vdj(prefix: str = "") -> Column:
    """fwr1..fwr4 joined, null if any part is null."""
    return cat(*[f"{prefix}{r}" for r in REGIONS])


def v_gene_part(prefix: str = "") -> Column:
    """fwr1..fwr3 (the V-gene encoded part)."""
    return cat(*[f"{prefix}{r}" for r in REGIONS[:5]])


def input_columns(mode: str, prefix: str = "", general_col: str = "full_sequence") -> tuple[Column, Column, Column]:
    """(sequence, start, end) for a mode; window is 0-based half-open.

    ``cdr3_from_VDJ`` scores the CDR3 window inside the full variable domain; the
    other modes score every position of their sequence.
    """
    if mode == "general":
        seq = _c(general_col)
    elif mode == "cdr3_only":
        seq = _c(f"{prefix}cdr3")
    elif mode == "v_gene_only":
        seq = v_gene_part(prefix)
    elif mode in ("full_VDJ", "cdr3_from_VDJ"):
        seq = full_vdj(prefix)
    else:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if mode == "cdr3_from_VDJ":
        start = F.length(v_gene_part(prefix)).cast("int")
        end = F.length(cat(*[f"{prefix}{r}" for r in REGIONS[:6]])).cast("int")
    else:
        start = F.when(seq.isNotNull(), F.lit(0))
        end = F.length(seq).cast("int")
    return seq, start, end


# V-gene families of the known mouse allow-list.
KNOWN_V_FAMILIES = [
    "IGHV1", "IGHV2", "IGHV3", "IGHV4", "IGHV5", "IGHV6", "IGHV7", "IGHV8", "IGHV9", "IGHV10", "IGHV11", "IGHV12", "IGHV13", "IGHV14", "IGHV15",
    "IGKV1", "IGKV2", "IGKV3", "IGKV4", "IGKV5", "IGKV6", "IGKV8", "IGKV9", "IGKV10", "IGKV11", "IGKV12", "IGKV13", "IGKV14", "IGKV15", "IGKV16",
    "IGKV17", "IGKV19", "IGKV20",
    "IGLV1", "IGLV2", "IGLV3",
]
