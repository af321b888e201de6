"""Registered queries: clustering agreement and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonalyze.functions.residues import argmax, binary_class, encode_labels, pad_labels, softmax_array
from clonalyze.operators import metrics as M
from clonalyze.plans.catalog.views_sql import with_views as W
from clonalyze.sources import fixtures as fx

ENTRIES: dict = {}


def reg(name, sql=None, views=(), extra=""):
    def deco(fn):
        ENTRIES[name] = (fn, W(sql, *views, extra=extra) if sql is not None else None)
        return fn
    return deco


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


ARI_SQL = """cont AS (SELECT g, a, b, count(*) AS n FROM src GROUP BY ALL),
sij AS (SELECT g, sum(n * (n - 1) / 2.0) AS s_ij, sum(n) AS n FROM cont GROUP BY ALL),
sa AS (SELECT g, sum(ai * (ai - 1) / 2.0) AS s_a FROM (SELECT g, a, sum(n) AS ai FROM cont GROUP BY ALL) x GROUP BY ALL),
sb AS (SELECT g, sum(bj * (bj - 1) / 2.0) AS s_b FROM (SELECT g, b, sum(n) AS bj FROM cont GROUP BY ALL) x GROUP BY ALL),
ari AS (SELECT g, s_ij, s_a * s_b / (n * (n - 1) / 2.0) AS ex, (s_a + s_b) / 2.0 AS mx FROM sij JOIN sa USING (g) JOIN sb USING (g))"""


@reg("E10_ari_by_sample", """WITH src AS (SELECT sample_id AS g, raw_clonotype_id AS a, v_gene AS b FROM contigs),
""" + ARI_SQL + """
SELECT g AS sample_id, round(CASE WHEN mx - ex = 0 THEN 1.0 ELSE (s_ij - ex) / (mx - ex) END, 6) AS ari FROM ari""", ("contigs",))
def e10s(spark, sf):
    c = fx.contigs(spark, sf)
    return _r(M.adjusted_rand_index(c, "raw_clonotype_id", "v_gene", by=["sample_id"]), ["ari"])


@reg("E10_ari_by_cluster", """WITH src AS (SELECT 0 AS g, label AS a, cluster AS b FROM scored_multi),
""" + ARI_SQL + """
SELECT round(CASE WHEN mx - ex = 0 THEN 1.0 ELSE (s_ij - ex) / (mx - ex) END, 6) AS ari FROM ari""", ("scored_multi",))
def e10(spark, sf):
    return _r(M.adjusted_rand_index(fx.scored_multi(spark, sf), "label", "cluster"), ["ari"])


@reg("E11_confusion_matrix", "SELECT label, pred, CAST(count(*) AS BIGINT) AS n FROM scored_multi GROUP BY ALL", ("scored_multi",))
def e11(spark, sf):
    return M.confusion(fx.scored_multi(spark, sf))


@reg("E12_classification_report", """WITH t AS (SELECT label AS k, count(*) AS support FROM scored_multi GROUP BY ALL),
p AS (SELECT pred AS k, count(*) AS npred FROM scored_multi GROUP BY ALL),
h AS (SELECT label AS k, count(*) AS tp FROM scored_multi WHERE label = pred GROUP BY ALL),
kk AS (SELECT k, coalesce(support, 0) AS support, coalesce(npred, 0) AS npred, coalesce(tp, 0) AS tp FROM t FULL JOIN p USING (k) LEFT JOIN h USING (k)),
m AS (SELECT k, support, tp, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM kk),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT CAST(k AS VARCHAR) AS "row", round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""", ("scored_multi",))
def e12(spark, sf):
    return _r(M.report(fx.scored_multi(spark, sf)), ["precision", "recall", "f1"])


BIN_CTES = """c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored_binary GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg FROM c),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c)"""


@reg("E13_roc_curve", """WITH """ + BIN_CTES + """
SELECT CAST(score AS DOUBLE) AS threshold, round(cum_neg / N, 6) AS fpr, round(cum_pos / P, 6) AS tpr FROM cum, tot
UNION ALL SELECT NULL, 0.0, 0.0""", ("scored_binary",))
def e13(spark, sf):
    return _r(M.roc(fx.scored_binary(spark, sf)), ["fpr", "tpr"])


@reg("E13_auc_average_precision", """WITH """ + BIN_CTES + """
SELECT round(sum(neg * (cum_pos - pos + pos / 2.0)) / (max(P) * max(N)), 6) AS auc,
  round(sum(pos * cum_pos / (cum_pos + cum_neg)) / max(P), 6) AS aupr, CAST(max(P) AS BIGINT) AS P, CAST(max(N) AS BIGINT) AS N FROM cum, tot""",
     ("scored_binary",))
def e13a(spark, sf):
    return _r(M.binary_summary(fx.scored_binary(spark, sf)), ["auc", "aupr"])


def _metrics_sql(src: str) -> str:
    return f"""WITH cnt AS (SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y <> 1 AND p = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN y = 1 AND p <> 1 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN y <> 1 AND p <> 1 THEN 1 ELSE 0 END)::DOUBLE AS tn FROM {src}),
c AS (SELECT score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg FROM c),
sm AS (SELECT sum(neg * (cum_pos - pos + pos / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) AS aupr FROM cum)
SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1, round(auc, 6) AS auc, round(aupr, 6) AS aupr,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END, 6) AS mcc,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM cnt, sm"""


MCOLS = ["precision", "recall", "f1", "auc", "aupr", "mcc", "accuracy"]


@reg("E16_token_metrics", _metrics_sql("tok"), ("token_labels",),
     extra="tok AS (SELECT CASE WHEN label = 'P' THEN 1 ELSE 0 END AS y, prob AS score, CAST(round_even(prob, 0) AS INT) AS p FROM token_labels)")
def e16(spark, sf):
    t = fx.token_labels(spark, sf).select(F.when(F.col("label") == "P", 1).otherwise(0).alias("y"), F.col("prob").alias("score"))
    t = t.withColumn("p", binary_class("score"))
    return _r(M.binary_metrics(t, "y", "score", pred="p"), MCOLS)


@reg("E16_token_metrics_padded", _metrics_sql("tok"), ("token_labels",),
     extra="""lists AS (SELECT list(CASE WHEN label = 'P' THEN 1 ELSE 0 END ORDER BY pos) AS l, list(prob ORDER BY pos) AS s FROM token_labels GROUP BY seq_id),
padded AS (SELECT list_concat(list_concat([-100], l), list_transform(range(149 - len(l)), lambda x: -100)) AS l,
  list_concat(list_concat([0.0], s), list_transform(range(149 - len(s)), lambda x: 0.0)) AS s FROM lists),
tok AS (SELECT y, score, CAST(round_even(score, 0) AS INT) AS p FROM (SELECT unnest(l) AS y, unnest(s) AS score FROM padded) u WHERE y <> -100)""")
def e16_padded(spark, sf):
    """The metrics from label arrays with specials and pads, which the marker leaves out (windows are shorter than 148)."""
    t = fx.token_labels(spark, sf).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "prob"))).alias("_t"))
    pads = F.array_repeat(F.lit(0.0), F.greatest(F.lit(149) - F.size("_t"), F.lit(0)))
    arrays = t.select(pad_labels(encode_labels(F.transform("_t", lambda x: x["label"]))).alias("labels"),
                      F.concat(F.array(F.lit(0.0)), F.slice(F.transform("_t", lambda x: x["prob"]), 1, 148), pads).alias("scores"))
    tokens = M.unpadded(arrays, "labels", "scores", y="y").withColumn("p", binary_class("score"))
    return _r(M.binary_metrics(tokens, "y", "score", pred="p"), MCOLS)


@reg("E17_H12_sequence_metrics", _metrics_sql("sb"), ("scored_binary",),
     extra="sb AS (SELECT label AS y, score, CAST(round_even(score, 0) AS INT) AS p FROM scored_binary)")
def e17(spark, sf):
    t = fx.scored_binary(spark, sf).withColumn("p", binary_class("score"))
    return _r(M.binary_metrics(t, "label", "score", pred="p"), MCOLS)


PROBS_CTE = """probs AS (SELECT seq_id AS id, label, list_transform(ex, lambda x: round(x / list_sum(ex), 6)) AS p FROM
  (SELECT seq_id, label, list_transform(f, lambda x: exp(x - list_max(f))) AS ex FROM
    (SELECT seq_id, label, list_transform(range(0, 10), lambda k: list_sum(list_filter(vec, lambda x, i: (i - 1) % 10 = k))) AS f FROM vectors) y) z),
ovr AS (SELECT id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS k, label, unnest(p) AS s FROM probs),
ovr2 AS (SELECT id, k, CASE WHEN label = k THEN 1 ELSE 0 END AS y, s FROM ovr)"""


def _probs(spark, sf):
    v = fx.vectors(spark, sf)
    # ten class scores from all dimensions: class k sums the dimensions d with d % 10 = k
    zero = F.lit(0.0)
    logits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.aggregate(
        F.filter("vec", lambda x, i: i % 10 == k), zero, lambda a, x: a + x))
    v = v.select(F.col("seq_id").alias("id"), "label", logits.alias("f"))
    return v.select("id", "label", F.transform(softmax_array(F.col("f")), lambda x: F.round(x, 6)).alias("p"))


@reg("E14_micro_auc", """WITH c AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM ovr2 GROUP BY s),
cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(neg) OVER (ORDER BY s DESC) AS cum_neg FROM c)
SELECT round(sum(neg * (cum_pos - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
  round(sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos), 6) AS aupr, CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM cum""",
     ("vectors",), extra=PROBS_CTE)
def e14(spark, sf):
    curve, summ = M.roc_micro(_probs(spark, sf), "label", "p")
    return _r(summ, ["auc", "aupr"])


@reg("H12_argmax_class", "SELECT id, label, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pred FROM probs", ("vectors",), extra=PROBS_CTE)
def h12(spark, sf):
    return _probs(spark, sf).select("id", "label", argmax("p").alias("pred"))


@reg("E15_macro_roc", """WITH c AS (SELECT k, s, sum(y) AS pos, sum(1 - y) AS neg FROM ovr2 GROUP BY ALL),
cum AS (SELECT k, sum(pos) OVER (PARTITION BY k ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY k ORDER BY s DESC) AS cn FROM c),
tot AS (SELECT k, sum(pos) AS P, sum(neg) AS N FROM c GROUP BY k),
pts AS (SELECT k, cn / N AS fpr, cp / P AS tpr FROM cum JOIN tot USING (k) UNION ALL SELECT k, 0.0, 0.0 FROM tot),
pf AS (SELECT k, fpr, min(tpr) AS lo, max(tpr) AS hi FROM pts GROUP BY ALL),
grid AS (SELECT k, CAST(r.i AS BIGINT) AS i, r.i / 999.0 AS x FROM tot CROSS JOIN range(0, 1000) r(i)),
g0 AS (SELECT g.k, g.i, g.x, pf.fpr AS x0, pf.hi AS y0 FROM grid g ASOF LEFT JOIN pf ON g.k = pf.k AND g.x >= pf.fpr),
g1 AS (SELECT g0.*, pf.fpr AS x1, pf.lo AS y1 FROM g0 ASOF LEFT JOIN pf ON g0.k = pf.k AND g0.x < pf.fpr),
curve AS (SELECT i, x, avg(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END) AS t FROM g1 GROUP BY i, x)
SELECT i AS point, x AS fpr, round(t, 6) AS tpr FROM curve
UNION ALL SELECT -1, NULL, round(sum(a), 6) FROM (SELECT (x - lag(x) OVER (ORDER BY i)) * (t + lag(t) OVER (ORDER BY i)) / 2.0 AS a FROM curve) z""",
     ("vectors",), extra=PROBS_CTE)
def e15(spark, sf):
    return _r(M.roc_macro(_probs(spark, sf), "label", "p"), ["tpr"])
