"""Likelihood jobs: score contigs (J4), widen scores (J6), combine with the
repertoire (J7) and summarise (E22). The flagship query lives here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.regions import REGIONS, collapse_isotype, full_vdj, gene_family, input_columns, seq_length, v_gene_part
from clonalyze.operators.arrays import LogArray, added, profile_logs, scored_length, sequence_scores, symbol_codes, total, with_profile_logs
from clonalyze.operators.joins import natural_join
from clonalyze.functions.residues import SKIP_CHARS
from clonalyze.operators.models import ContextModel, ProfileModel, residues
from clonalyze.session import materialize

CONTIG_KEY = ["barcode", "contig_id", "chain", "v_gene", "d_gene", "j_gene", "c_gene", "raw_clonotype_id",
              "raw_consensus_id"]


def heavy_training(contigs: DataFrame) -> DataFrame:
    """Training sequences for the built-in models: full heavy-chain variable domains."""
    return contigs.filter(F.col("chain") == "IGH").select(full_vdj().alias("sequence"), gene_family("v_gene").alias("v_family"))


def chain_type() -> Column:
    """Heavy chains have a model of their own, all others share the light one."""
    return F.when(F.col("chain") == "IGH", "heavy").otherwise("light")


def chain_training(contigs: DataFrame) -> DataFrame:
    """Training sequences of the chain-specific models: full variable domains of all chains."""
    return contigs.select(full_vdj().alias("sequence"), gene_family("v_gene").alias("v_family"), chain_type().alias("chain_type"))


def fit_models(training: DataFrame, names: Sequence[str] = ("context", "profile")) -> dict:
    """Chain-specific models of ``chain_training`` rows (a V family belongs to one chain)."""
    models = {}
    if "context" in names:
        models["context"] = ContextModel(by=["chain_type"]).fit(training)
    if "profile" in names:
        models["profile"] = ProfileModel("v_family").fit(training)
    return models


def score(contigs: DataFrame, modes: Sequence[str], models: dict, keys: Sequence[str] = ("seq_id",),
          id: str | None = "seq_id") -> DataFrame:
    """Long table (keys, model, mode, n_pos, pll) for every mode and model.

    Rows whose mode input is null (a missing region) are dropped, as the scoring scripts do. Contigs scored by
    fitted models stay one row each until the scores of the modes are unpivoted (``mode_scores``); any other
    provider looks its probabilities up on exploded residues.
    """
    keys = list(keys)
    if _by_arrays(modes, models):
        per = mode_scores(contigs, modes, models, keys)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m).alias("mode"), F.col(f"_n_{m}").alias("n_pos"), F.col(f"_pll_{n}_{m}").alias("pll"))
                                   for m in modes for n in models])).alias("_s")
        return per.select(*keys, each).select(*keys, "_s.*").filter("n_pos is not null").select(*keys, "model", "mode", "n_pos", "pll")
    if id and id in contigs.columns and len(keys) > 1 and id in keys:
        narrow = score(contigs, modes, models, [id], id=None)
        meta = contigs.select(*keys)
        return narrow.join(meta, id).select(*keys, "model", "mode", "n_pos", "pll")
    names = list(models)
    res = _looked_up(contigs, modes, models, keys)
    ok = F.col("aa").isNotNull() & ~F.col("aa").isin(*SKIP_CHARS)
    aggs = [F.count(F.when(ok, F.lit(1))).cast("long").alias("n_pos")]
    aggs += [F.avg(F.when(ok, F.ln(f"_p_{n}"))).alias(f"_pll_{n}") for n in names]
    per = res.groupBy(*keys, "mode").agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_pll_{n}").alias("pll")) for n in names]))
    return per.select(*keys, "mode", "n_pos", stack.alias("_s")).select(*keys, "_s.model", "mode", "n_pos", "_s.pll")


def _looked_up(contigs: DataFrame, modes: Sequence[str], models: dict, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, mode, residue) with every model's probability as ``_p_{model}``."""
    specs = []
    for mode in modes:
        seq, start, end = input_columns(mode)
        specs.append(F.struct(F.lit(mode).alias("mode"), seq.alias("sequence"), start.alias("start_pos"), end.alias("end_pos")))
    own = [gene_family("v_gene").alias("v_family"), chain_type().alias("chain_type")]
    base = (contigs.select(*keys, *own, F.explode(F.array(*specs)).alias("_m"))
            .select(*keys, "v_family", "chain_type", "_m.*").filter(F.col("sequence").isNotNull()))
    res = residues(base, "sequence", keep=[*keys, "v_family", "chain_type", "mode"], start="start_pos", end="end_pos", outer=True)
    for name in models:
        res = models[name].lookup(res).withColumnRenamed("prob", f"_p_{name}")
    return res


ARRAY_MODES = ("cdr3_only", "v_gene_only", "full_VDJ", "cdr3_from_VDJ")


def _by_arrays(modes: Sequence[str], models: dict) -> bool:
    return set(modes) <= set(ARRAY_MODES) and all(
        (isinstance(m, ContextModel) and len(m.by) <= 1) or isinstance(m, ProfileModel) for m in models.values())


def mode_scores(contigs: DataFrame, modes: Sequence[str], models: dict, keys: Sequence[str]) -> DataFrame:
    """Every mode's ``_n_{mode}`` (null where its input is) and ``_pll_{model}_{mode}`` on the contig's own row.

    The regions that a contig has make one sequence, and every model one array of log probabilities of its residues. A mode
    is a window of it: its score is the sum over a slice. Only what a window sees differently is looked up anew: the
    first and the last residue, whose neighbour is the window's end, and positions that a profile counts from the
    window's start. Nothing is exploded or shuffled.
    """
    keys = list(keys)
    lengths = [F.coalesce(F.length(r), F.lit(0)) for r in REGIONS]
    v_end = sum(lengths[1:5], lengths[0])
    has = {"cdr3_only": F.col("cdr3").isNotNull(), "v_gene_only": v_gene_part().isNotNull(), "full_VDJ": full_vdj().isNotNull(), "cdr3_from_VDJ": full_vdj().isNotNull()}
    text = F.concat(*[F.coalesce(r, F.lit("")) for r in REGIONS])
    base = contigs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], gene_family("v_gene").alias("v_family"), chain_type().alias("chain_type"),
                          text.alias("_s"), v_end.cast("int").alias("_v"), (v_end + lengths[5]).cast("int").alias("_c"), *[has[m].alias(f"_has_{m}") for m in modes])
    v, c, n = F.col("_v"), F.col("_c"), F.length("_s")
    scored = {"v": scored_length(F.substring("_s", F.lit(1), v)), "c": scored_length(F.substring("_s", v + 1, c - v)), "rest": scored_length(F.substring("_s", c + 1, n - c))}
    own = base.select("*", *[x.alias(f"_n{k}") for k, x in scored.items()])
    count = {"cdr3_only": F.col("_nc"), "v_gene_only": F.col("_nv"), "full_VDJ": F.col("_nv") + F.col("_nc") + F.col("_nrest"), "cdr3_from_VDJ": F.col("_nc")}
    sums = {}
    for name, model in models.items():
        context = isinstance(model, ContextModel)
        codes, logs = F.col(f"_y_{name}"), F.col(f"_l_{name}")
        if context:
            t = LogArray(model)
            own = own.withColumn(f"_y_{name}", t.codes(F.col("_s"))).withColumn(f"_l_{name}", t.over(codes))
        else:
            own = with_profile_logs(own, model).withColumn(f"_y_{name}", symbol_codes(F.col("_s"))).withColumn(f"_l_{name}", profile_logs(codes))
        # every position is added once: the V part but its last one, CDR3 but its ends, the rest
        parts = {"v": added(logs, F.lit(0), v - 1), "v_last": F.when(v > 0, F.get(logs, v - 1)).otherwise(0.0), "c": added(logs, v + 1, c - 1),
                 "c_first": F.when(c > v, F.get(logs, v)).otherwise(0.0), "c_last": F.when(c - v > 1, F.get(logs, c - 1)).otherwise(0.0), "rest": added(logs, c, F.size(logs))}
        if context:     # symbol i + 1 is that of position i
            parts["v_edge"] = F.when(v > 0, t.value(F.get(codes, v - 1), F.lit(t.end), F.get(codes, v))).otherwise(0.0)
            parts["c_edges"] = (F.when(c - v > 1, t.value(F.lit(t.start), F.get(codes, v + 2), F.get(codes, v + 1)) + t.value(F.get(codes, c - 1), F.lit(t.end), F.get(codes, c)))
                                .when(c - v == 1, t.value(F.lit(t.start), F.lit(t.end), F.get(codes, v + 1))).otherwise(0.0))
        elif "cdr3_only" in modes:
            moved = F.when(c > v, profile_logs(F.slice(codes, v + 1, c - v))).otherwise(F.array().cast("array<double>"))
            parts["c_moved"] = total(moved)
        own = own.select("*", *[x.alias(f"_{k}_{name}") for k, x in parts.items()]).drop(f"_y_{name}", f"_l_{name}", *([] if context else ["_profile"]))
        p = {k: F.col(f"_{k}_{name}") for k in parts}
        cdr3 = p["c"] + p["c_first"] + p["c_last"]
        sums[name, "full_VDJ"], sums[name, "cdr3_from_VDJ"] = p["v"] + p["v_last"] + cdr3 + p["rest"], cdr3
        sums[name, "v_gene_only"] = p["v"] + p["v_edge" if context else "v_last"]
        sums[name, "cdr3_only"] = p["c"] + p["c_edges"] if context else p.get("c_moved")
    cols = []
    for m in modes:
        present = F.when(F.col(f"_has_{m}"), count[m])
        cols.append(present.alias(f"_n_{m}"))
        cols += [F.when(present > 0, sums[name, m] / present).alias(f"_pll_{name}_{m}") for name in models]
    return own.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *cols)


def score_wide(contigs: DataFrame, modes: Sequence[str], models: dict, keys: Sequence[str], id: str = "seq_id") -> DataFrame:
    """J6 on the contig's own row: a column ``evo_likelihood_{model}_{mode}`` each. Rows that miss a mode are dropped, like an inner join."""
    per = mode_scores(contigs, modes, models, keys)
    for m in modes:
        per = per.filter(F.col(f"_n_{m}").isNotNull())
    return per.select(*keys, *[F.col(f"_pll_{n}_{m}").alias(f"evo_likelihood_{n}_{m}") for m in modes for n in models])


def aggregate_scores(scores: DataFrame, keys: Sequence[str], models: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """J6 (C1/C2 as a pivot): one row per key, one column ``evo_likelihood_{model}_{mode}``.

    A ``groupBy(keys).pivot`` groups null keys together, so it replaces the chain of
    null-safe joins; rows missing any model/mode are dropped like an inner join.
    """
    tag = F.concat(F.lit("evo_likelihood_"), F.col("model"), F.lit("_"), F.col("mode"))
    values = [f"evo_likelihood_{m}_{mode}" for mode in modes for m in models]
    # first(struct) is non-null exactly when the (model, mode) row exists, even for a null score
    wide = scores.withColumn("_tag", tag).groupBy(*keys).pivot("_tag", values).agg(F.first(F.struct("pll")))
    wide = wide.filter(F.greatest(*[F.col(v).isNull() for v in values]) == F.lit(False))
    return wide.select(*keys, *[F.col(v)["pll"].alias(v) for v in values])


def combine(repertoire: DataFrame, scores: DataFrame) -> DataFrame:
    """Single-heavy-chain cells natural-joined to heavy-chain scores, with derived columns."""
    vdj = repertoire.filter(F.col("nr_of_vdj_chains") == 1)
    sc = scores.filter(F.col("chain") == "IGH").withColumn("barcode", F.substring_index("barcode", "-", 1))
    if "seq_id" in vdj.columns and "seq_id" in sc.columns:
        # one hash key; the other shared columns are compared on the joined row
        shared = [c for c in vdj.columns if c in sc.columns and c != "seq_id"]
        right = sc.select("seq_id", *[F.col(c).alias(f"_r_{c}") for c in shared], *[c for c in sc.columns if c not in vdj.columns])
        j = vdj.join(right, "seq_id")
        for c in shared:
            j = j.filter(F.col(c).eqNullSafe(F.col(f"_r_{c}")))
        j = j.drop(*[f"_r_{c}" for c in shared])
    else:
        j = natural_join(vdj, sc)
    return (j.withColumn("vdj_cgene", collapse_isotype("vdj_cgene"))
            .withColumn("c_gene", F.col("vdj_cgene"))
            .withColumn("v_gene_family", gene_family("v_gene"))
            .withColumn("vdj_cdr3_length", seq_length("hc_cdr3"))
            .withColumn("full_vdj_aa", full_vdj("hc_"))
            .withColumn("full_vdj_length", seq_length(full_vdj("hc_"))))


def distribution(scored: DataFrame, by: Sequence[str], value: str = "pll", quartiles: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Summary per group (count, mean, sample sd, min, max), with ``quartiles`` also q1, median and q3.

    Only mergeable aggregates: a hot group is combined map-side and never
    collected into one task. Quartiles come from a mergeable quantile sketch (Greenwald-Khanna) of bounded size: a value whose
    rank is off by at most 1 / ``accuracy`` of the group's rows, exact for groups of up to ``accuracy`` rows.
    """
    v = F.col(value)
    more = []
    if quartiles:
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        more = [F.round(F.get(q, F.lit(i)), 6).alias(n) for i, n in enumerate(("q1_pll", "median_pll", "q3_pll"))]
    return scored.groupBy(*by).agg(
        *more,
        F.count(v).cast("long").alias("n_seq"), F.round(F.avg(v), 6).alias("mean_pll"),
        F.round(F.stddev_samp(v), 6).alias("sd_pll"), F.round(F.min(v), 6).alias("min_pll"),
        F.round(F.max(v), 6).alias("max_pll"))


def pll_by_isotype_family(contigs: DataFrame) -> DataFrame:
    """Flagship: mean pseudo-log-likelihood per isotype and V family, heavy chains only.

    contigs -> heavy (B1) -> full VDJ (B7) -> context model fitted on the same
    sequences (J3) -> per-sequence PLL (E1) -> isotype / family (H1, H3) -> E22.
    """
    heavy = contigs.filter(F.col("chain") == "IGH").select(
        "seq_id", collapse_isotype("c_gene").alias("isotype"), gene_family("v_gene").alias("v_family"),
        full_vdj().alias("sequence")).filter(F.col("sequence").isNotNull())
    heavy = materialize(heavy)   # fitted on and scored against the same rows
    model = ContextModel().fit(heavy)
    pll = sequence_scores(heavy, model, ["seq_id", "isotype", "v_family"])
    return distribution(pll, ["isotype", "v_family"])
