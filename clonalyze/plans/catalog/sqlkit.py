"""DuckDB building blocks shared by the oracle queries (written independently of
the Spark code so that the pair check compares two derivations)."""

from __future__ import annotations

from clonalyze.functions.residues import ALPHABET

ALPHA_SQL = ", ".join(f"'{a}'" for a in ALPHABET)
FULL = "fwr1 || cdr1 || fwr2 || cdr2 || fwr3 || cdr3 || fwr4"
VPART = "fwr1 || cdr1 || fwr2 || cdr2 || fwr3"
IGG = "'IGHG1', 'IGHG2', 'IGHG2B', 'IGHG2C', 'IGHG3', 'IGHG4'"
IGA = "'IGHA1', 'IGHA2'"


def isotype(col: str) -> str:
    return f"CASE WHEN {col} IN ({IGG}) THEN 'IGHG' WHEN {col} IN ({IGA}) THEN 'IGHA' ELSE {col} END"


def residues(name: str, src: str, keys: str, seq: str = "s", start: str = "0", end: str | None = None) -> str:
    """CTE: one row per residue in [start, end) with neighbours in the whole sequence."""
    end = end or f"length({seq})"
    return f"""
{name} AS (SELECT {keys}, p AS pos, substr({seq}, p + 1, 1) AS aa,
  CASE WHEN p > 0 THEN substr({seq}, p, 1) ELSE '^' END AS lft,
  CASE WHEN p < length({seq}) - 1 THEN substr({seq}, p + 2, 1) ELSE '$' END AS rgt
  FROM (SELECT *, CAST(unnest(range({start}, {end})) AS INT) AS p FROM {src} WHERE {seq} IS NOT NULL) z)"""


def context_model(train_src: str, seq: str = "s", prefix: str = "ctx") -> str:
    """CTEs {prefix}_n (lft, rgt, aa, n) and {prefix}_t (lft, rgt, total) fitted on train_src."""
    return residues(f"{prefix}_res", train_src, "1 AS one", seq) + f""",
{prefix}_n AS (SELECT lft, rgt, aa, count(*) AS n FROM {prefix}_res WHERE aa IN ({ALPHA_SQL}) GROUP BY lft, rgt, aa),
{prefix}_t AS (SELECT lft, rgt, sum(n) AS total FROM {prefix}_n GROUP BY lft, rgt)"""


def context_prob(res: str, aa: str = "aa", prefix: str = "ctx", lft: str = "lft", rgt: str = "rgt") -> tuple[str, str]:
    """(join clause, prob expression) for looking up P(aa | lft, rgt)."""
    j = (f"LEFT JOIN {prefix}_t t_{aa} ON t_{aa}.lft = {res}.{lft} AND t_{aa}.rgt = {res}.{rgt} "
         f"LEFT JOIN {prefix}_n n_{aa} ON n_{aa}.lft = {res}.{lft} AND n_{aa}.rgt = {res}.{rgt} AND n_{aa}.aa = {res}.{aa}")
    p = f"(coalesce(n_{aa}.n, 0) + 1.0) / (coalesce(t_{aa}.total, 0) + {len(ALPHABET)})"
    return j, p


HEAVY_TRAIN = f"heavy_train AS (SELECT {FULL} AS s, split_part(v_gene, '-', 1) AS v_family FROM contigs WHERE chain = 'IGH')"
