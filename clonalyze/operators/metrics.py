"""Evaluation metrics as aggregations.

No metric enumerates pairs of rows or sorts the whole table in one task:

* ARI works on the contingency table (one row per label pair).
* ROC / AUC / average precision work on one row per distinct score, with
  running totals computed by ``running_totals`` (range partitioning plus
  per-partition offsets), and AUC as the Mann-Whitney sum over distinct scores,
  which equals the trapezoid area of the ROC curve with ties.
* The macro ROC interpolates on a fixed 1000-point grid: every curve is first
  reduced to at most one row per grid cell, so every window is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonalyze.functions.residues import IGNORE
from clonalyze.operators.joins import null_safe_join
from clonalyze.session import cut_lineage


def _comb2(c: Column) -> Column:
    return c * (c - 1) / 2.0


def _merge_rows(dfs, by: Sequence[str]) -> DataFrame:
    """Combine per-group result rows of several aggregates without a join: union
    them and take each column's one non-null value per group (a global aggregate
    when there is no group)."""
    u = dfs[0]
    for d in dfs[1:]:
        u = u.unionByName(d, allowMissingColumns=True)
    vals = [c for c in u.columns if c not in by]
    return u.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in vals])


def adjusted_rand_index(df: DataFrame, a: str, b: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """ARI of two labelings (per group ``by``); a zero denominator gives 1.0.

    Contingency counts, then the three pair-count sums from one union and one
    aggregation (no joins, no pairs of rows). ``count`` names the number of rows that a row of ``df`` stands for."""
    by = list(by)
    cont = df.groupBy(*by, a, b).agg((F.sum(count) if count else F.count("*")).alias("nij"))
    rows = cont.groupBy(*by, a).agg(F.sum("nij").alias("x"))
    cols = cont.groupBy(*by, b).agg(F.sum("nij").alias("x"))
    parts = (cont.select(*by, F.lit("ij").alias("_k"), F.col("nij").alias("x"))
             .unionByName(rows.select(*by, F.lit("a").alias("_k"), "x"))
             .unionByName(cols.select(*by, F.lit("b").alias("_k"), "x")))
    j = parts.groupBy(*by).agg(
        F.sum(F.when(F.col("_k") == "ij", _comb2(F.col("x")))).alias("s_ij"),
        F.sum(F.when(F.col("_k") == "ij", F.col("x"))).alias("n"),
        F.sum(F.when(F.col("_k") == "a", _comb2(F.col("x")))).alias("s_a"),
        F.sum(F.when(F.col("_k") == "b", _comb2(F.col("x")))).alias("s_b"))
    expected = F.col("s_a") * F.col("s_b") / _comb2(F.col("n"))
    mx = (F.col("s_a") + F.col("s_b")) / 2.0
    den = mx - expected
    ari = F.when(den == 0, F.lit(1.0)).otherwise((F.col("s_ij") - expected) / den)
    return j.select(*by, ari.alias("ari"))


def confusion(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """Confusion matrix as (label, pred, n)."""
    return df.groupBy(y, p).agg(F.count("*").cast("long").alias("n"))


def report(df: DataFrame, y: str = "label", p: str = "pred", count: str | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, plus accuracy, macro and
    weighted averages (zero denominators give 0). Columns: (row, precision, recall, f1, support).

    ``count`` names the number of rows that a row of ``df`` stands for."""
    n = F.sum(count) if count else F.count("*")
    truth = df.groupBy(F.col(y).alias("k")).agg(n.alias("support"))
    predicted = df.groupBy(F.col(p).alias("k")).agg(n.alias("npred"))
    hits = df.filter(F.col(y) == F.col(p)).groupBy(F.col(y).alias("k")).agg(n.alias("tp"))
    k = truth.join(predicted, "k", "full").join(hits, "k", "left").na.fill(0, ["support", "npred", "tp"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    k = k.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    k = k.withColumn("f1", f1)
    per = k.select(F.col("k").cast("string").alias("row"), "precision", "recall", "f1", F.col("support").cast("long"))
    tot = k.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                F.avg("f1").alias("mf"), F.sum(F.col("precision") * F.col("support")).alias("wp"),
                F.sum(F.col("recall") * F.col("support")).alias("wr"), F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"), F.col("n").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("n").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("row"), (F.col("wp") / F.col("n")).alias("precision"),
                          (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                          F.col("n").cast("long").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def running_totals(df: DataFrame, order: Column, cols: Sequence[str], by: Sequence[str] = (), prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``cols`` along ``order`` (within ``by``), without
    a single-partition window: range-partition on (by, order), sum locally, then add
    the totals of the earlier partitions of the same group (a table of at most
    partitions x groups rows, broadcast)."""
    by = list(by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed once: range bounds from sampling differ between evaluations
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in by], order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(c).over(w).alias(f"_l_{c}") for c in cols])
    part = ranged.groupBy(*by, "_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = part.select(*by, "_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    j = null_safe_join(local, offs, [*by, "_pid"])   # rows: groups + partitions; AQE picks the join from its measured size
    out = j.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in cols])
    return out


def score_counts(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    return df.groupBy(*by, s).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
                                  F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))


def roc(df: DataFrame, y: str = "label", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """ROC points at every distinct threshold (descending), plus the (0, 0) start.

    Columns: (by..., threshold, fpr, tpr). Thresholds are the distinct scores; the
    start point has a null threshold.
    """
    by = list(by)
    c = score_counts(df, y, s, by)
    cum = running_totals(c, F.col(s).desc(), ["pos", "neg"], by)
    tot = c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        j = cum.join(tot, by)
    else:   # two numbers: attach as literals instead of joining a one-row table
        t = tot.first()
        j = cum.withColumn("P", F.lit(t["P"])).withColumn("N", F.lit(t["N"]))
    pts = j.select(*by, F.col(s).cast("double").alias("threshold"),
                   F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"), F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = tot.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def binary_summary(df: DataFrame, y: str = "label", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """AUC (Mann-Whitney over distinct scores = trapezoid ROC area) and average
    precision (step sum: sum over thresholds of recall gain x precision)."""
    return _summary(score_counts(df, y, s, by), s, list(by))


def _summary(c: DataFrame, s: str, by: list[str]) -> DataFrame:
    cum = running_totals(c, F.col(s).desc(), ["pos", "neg"], by)
    above = F.col("cum_pos") - F.col("pos")          # positives with a strictly higher score
    per = cum.groupBy(*by).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2.0)).alias("mw"),
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("ap_num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return per.select(*by, F.try_divide(F.col("mw"), F.col("P") * F.col("N")).alias("auc"),
                      F.try_divide(F.col("ap_num"), F.col("P")).alias("aupr"), "P", "N")


def unpadded(df: DataFrame, labels: str, scores: str, keep: Sequence[str] = (), y: str = "label", s: str = "score") -> DataFrame:
    """One row a token of padded label arrays (H13), those with the ignore marker left out; ``scores`` has an
    entry for every label, specials and pads included."""
    tokens = df.select(*keep, F.explode(F.arrays_zip(F.col(labels).alias("y"), F.col(scores).alias("s"))).alias("_t"))
    return tokens.select(*keep, F.col("_t.y").alias(y), F.col("_t.s").alias(s)).filter(F.col(y) != IGNORE)


def binary_metrics(df: DataFrame, y: str = "label", s: str = "score", pred: str | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, AUC, AUPR (average precision), MCC and accuracy.

    The class is ``pred`` when given, else the score rounded half to even (H12).
    """
    by = list(by)
    p = F.col(pred) if pred else F.bround(F.col(s), 0)
    t = F.col(y) == 1
    # read once: a row a score and class is all that both halves need
    rows = df.groupBy(*by, F.col(s).alias("_s"), (p == 1).alias("_h")).agg(
        F.sum(F.when(t, 1).otherwise(0)).alias("pos"), F.sum(F.when(~t, 1).otherwise(0)).alias("neg"), F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows)
    h = F.col("_h")
    counts = rows.groupBy(*by).agg(
        F.sum(F.when(h, F.col("pos")).otherwise(0)).cast("double").alias("tp"), F.sum(F.when(h, F.col("neg")).otherwise(0)).cast("double").alias("fp"),
        F.sum(F.when(~h, F.col("pos")).otherwise(0)).cast("double").alias("fn"), F.sum(F.when(~h, F.col("neg")).otherwise(0)).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)
    acc = (tp + tn) / (tp + tn + fp + fn)
    m = counts.select(*by, prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), mcc.alias("mcc"), acc.alias("accuracy"))
    scores = rows.groupBy(*by, "_s").agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    summ = _summary(scores, "_s", by).select(*by, "auc", "aupr")
    return _merge_rows([m, summ], by).select(*by, "precision", "recall", "f1", "auc", "aupr", "mcc", "accuracy")


def one_vs_rest(df: DataFrame, y: str, probs: str, id: str = "id") -> DataFrame:
    """One row per (row, class) with a binary label and that class's probability."""
    return df.select(id, y, F.posexplode(probs).alias("k", "s")).select(
        id, "k", F.when(F.col(y) == F.col("k"), 1).otherwise(0).alias("y"), F.col("s").cast("double").alias("s"))


def roc_micro(df: DataFrame, y: str, probs: str, id: str = "id") -> DataFrame:
    """Micro-average ROC / AUC: every (row, class) pair pooled."""
    ovr = one_vs_rest(df, y, probs, id)
    return roc(ovr, "y", "s"), binary_summary(ovr, "y", "s")


def roc_macro(df: DataFrame, y: str, probs: str, id: str = "id", grid: int = 1000) -> DataFrame:
    """Mean over classes of each class's TPR linearly interpolated on a
    ``grid``-point FPR grid (0..1), and the trapezoid AUC of that mean curve.

    Returns (point, fpr, tpr) rows and, as point -1, the AUC in ``tpr``.
    """
    g1 = grid - 1
    ovr = one_vs_rest(df, y, probs, id)
    c = score_counts(ovr, "y", "s", ["k"])
    cum = running_totals(c, F.col("s").desc(), ["pos", "neg"], ["k"])
    tot = c.groupBy("k").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = cum.join(tot, "k").select("k", "cum_neg", "N", F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
                                    F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = tot.select("k", F.lit(0).cast("long").alias("cum_neg"), "N", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = pts.unionByName(start)
    # grid cell of a point: smallest i with fpr <= i / g1, in exact integer arithmetic
    cell = F.expr(f"(cum_neg * {g1} + N - 1) div N")
    cells = pts.withColumn("cell", cell).groupBy("k", "cell").agg(
        F.max_by(F.struct("fpr", "tpr"), F.struct("fpr", "tpr")).alias("hi"),   # last point of the cell
        F.min_by(F.struct("fpr", "tpr"), F.struct("fpr", "tpr")).alias("lo"))   # first point of the cell
    grid_rows = tot.select("k", F.explode(F.sequence(F.lit(0), F.lit(g1))).alias("cell"))
    g = grid_rows.join(cells, ["k", "cell"], "left")
    upto = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("k").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    g = g.withColumn("p0", F.last("hi", ignorenulls=True).over(upto)).withColumn("p1", F.first("lo", ignorenulls=True).over(after))
    x = F.col("cell") / float(g1)
    x0, y0, x1, y1 = F.col("p0.fpr"), F.col("p0.tpr"), F.col("p1.fpr"), F.col("p1.tpr")
    interp = F.when(F.col("p1").isNull(), y0).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))
    mean = g.withColumn("itpr", interp).groupBy("cell").agg(F.avg("itpr").alias("tpr"))
    curve = mean.select(F.col("cell").alias("point"), (F.col("cell") / float(g1)).alias("fpr"), "tpr")
    w = Window.orderBy("point")   # bounded: ``grid`` rows
    area = curve.withColumn("_a", (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2.0)
    auc = area.agg(F.sum("_a").alias("tpr")).select(F.lit(-1).cast("long").alias("point"), F.lit(None).cast("double").alias("fpr"), "tpr")
    return curve.select(F.col("point").cast("long"), "fpr", "tpr").unionByName(auc)
