"""Registered queries: machine-learning jobs (M1-M17). Estimator outputs have no
SQL twin (rows-only check); the exact parts (label codes, balancing counts,
standardisation, Gaussian naive-Bayes parameters) are paired with DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.regions import full_vdj
from clonalyze.operators import metrics as M
from clonalyze.operators import ml as ML
from clonalyze.operators.corpus import hash_split
from clonalyze.operators.aggregates import best_by
from clonalyze.operators.embed import long_form
from clonalyze.operators.joins import multi_member
from clonalyze.plans.catalog.views_sql import with_views as W
from clonalyze.plans.clusters import cluster_benchmark
from clonalyze.session import cut_lineage
from clonalyze.sources import fixtures as fx
from clonalyze.sources.tables import table

ENTRIES: dict = {}


def reg(name, sql=None, views=(), extra=""):
    def deco(fn):
        ENTRIES[name] = (fn, W(sql, *views, extra=extra) if sql is not None else None)
        return fn
    return deco


@reg("M1_encode_labels", "SELECT seq_id, CAST(dense_rank() OVER (ORDER BY v_gene) - 1 AS INT) AS label_idx FROM contigs", ("contigs",))
def m1(spark, sf):
    c = fx.contigs(spark, sf).select("seq_id", "v_gene")
    return ML.encode_labels(c, "v_gene").select("seq_id", F.col("label_idx").cast("int").alias("label_idx"))


@reg("M2_oversample_class_counts", """SELECT label, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM scored_binary GROUP BY label) c) AS BIGINT) AS n
FROM scored_binary GROUP BY label""", ("scored_binary",))
def m2(spark, sf):
    o = ML.oversample(fx.scored_binary(spark, sf), "label", "id")
    return o.groupBy("label").agg(F.count("*").cast("long").alias("n"))


_U0 = "(CAST(('0x' || substr(md5(concat_ws(':', '0', CAST(id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0)"


@reg("M2_oversample_rows", f"""WITH c AS (SELECT label, count(*) AS n FROM scored_binary GROUP BY label),
r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY {_U0}, id) AS k FROM scored_binary)
SELECT r.label, r.id, CAST((SELECT max(n) FROM c) // n + CASE WHEN k <= (SELECT max(n) FROM c) % n THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r JOIN c USING (label)""", ("scored_binary",))
def m2_rows(spark, sf):
    """How often every row of every class is taken."""
    return ML.oversample(fx.scored_binary(spark, sf), "label", "id").groupBy("label", "id").agg(F.count("*").alias("copies"))


_U = "(CAST(('0x' || substr(md5(concat_ws(':', '42', CAST(seq_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0)"


@reg("M3_standardise_train_stats", f"""WITH t AS (SELECT seq_id, vec FROM vectors WHERE {_U} >= 0.1),
d AS (SELECT CAST(generate_subscripts(vec, 1) AS INT) AS dim, unnest(vec) AS x FROM t),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM d GROUP BY dim),
a AS (SELECT seq_id, CAST(generate_subscripts(vec, 1) AS INT) AS dim, unnest(vec) AS x FROM vectors)
SELECT a.seq_id, a.dim - 1 AS dim, round(CASE WHEN s.sd > 0 THEN (a.x - s.m) / s.sd ELSE a.x - s.m END, 6) AS value
FROM a JOIN s USING (dim)""", ("vectors",))
def m3(spark, sf):
    v = fx.vectors(spark, sf)
    train = hash_split(v, "seq_id", [("eval", 0.1), ("train", 0.9)], salt="42").filter("split = 'train'")
    out = ML.standardise(train, v, "vec", out="vec_std").select("seq_id", F.col("vec_std").alias("vec"))
    return long_form(out, ["seq_id"]).withColumn("value", F.round("value", 6))


@reg("M7_gaussian_nb_parameters", """WITH d AS (SELECT label, CAST(generate_subscripts(vec, 1) - 1 AS INT) AS dim, unnest(vec) AS x FROM vectors)
SELECT label, dim, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var,
  round(count(*) / (SELECT count(*) FROM vectors) / 64.0, 6) AS prior FROM d GROUP BY label, dim""", ("vectors",))
def m7(spark, sf):
    """Gaussian naive Bayes as plain aggregation: per class and dimension mean and
    (population) variance, and the class prior."""
    v = fx.vectors(spark, sf)
    total = v.count()
    d = long_form(v, ["label"]).withColumnRenamed("value", "x")
    return d.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("var"),
                                         F.round(F.count("*") / F.lit(float(total)) / 64.0, 6).alias("prior"))


@reg("M4_early_stop")
def m4(spark, sf):
    """Validation loss of every round of the network until it stops; the kept round is marked."""
    v = fx.vectors(spark, sf)
    n = v.select(F.size("vec")).first()[0]
    est = ML.classifiers(n, v.agg(F.max("label")).first()[0] + 1)["neural_network"]
    train = v.select("seq_id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    _, history = ML.fit_early_stopped(est, train)
    return spark.createDataFrame(history, "round int, loss double, kept boolean")


@reg("M9_compare_classifiers")
def m9(spark, sf):
    preds = ML.compare_classifiers(fx.vectors(spark, sf), "label", "vec", "seq_id", eval_size=0.2, scaling=True)
    return preds.groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


@reg("M9_classifier_reports")
def m9r(spark, sf):
    """Report, confusion matrix and micro ROC area of every model, as (model, part, row, col, value)."""
    preds = ML.compare_classifiers(fx.vectors(spark, sf), "label", "vec", "seq_id", eval_size=0.2)
    parts = []
    conf = cut_lineage(preds.groupBy("model", "label", "pred").agg(F.count("*").alias("n")))     # all that reports need
    for m in ML.classifiers(4, 2):
        rep = M.report(conf.filter(F.col("model") == m), count="n")
        each = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in ("precision", "recall", "f1", "support")]))
        parts.append(rep.select(F.lit(m).alias("model"), F.lit("report").alias("part"), F.col("row").cast("string").alias("row"), each))
    parts.append(conf.select("model", F.lit("confusion").alias("part"), F.col("label").cast("string").alias("row"), F.col("pred").cast("string").alias("col"),
                             F.col("n").cast("double").alias("value")))
    pooled = preds.select("model", "label", F.posexplode("prob").alias("k", "s")).withColumn("y", (F.col("label") == F.col("k")).cast("int"))
    area = M.binary_summary(pooled, "y", "s", by=["model"])
    parts.append(area.select("model", F.lit("roc").alias("part"), F.lit("micro").alias("row"), F.lit("auc").alias("col"), F.col("auc").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


@reg("M9_roc_curves")
def m9_roc(spark, sf):
    """ROC points of every model, classes pooled (micro): a row a distinct score, and the start of each curve."""
    preds = ML.compare_classifiers(fx.vectors(spark, sf), "label", "vec", "seq_id", eval_size=0.2)
    pooled = preds.select("model", "label", F.posexplode("prob").alias("k", "s")).withColumn("y", (F.col("label") == F.col("k")).cast("int"))
    return M.roc(pooled, "y", "s", by=["model"])


@reg("M10_M12_cluster_benchmark")
def m12(spark, sf):
    v = fx.vectors(spark, sf)
    out = None
    for method in ("kmeans", "bisecting"):
        c = ML.cluster(v, method, 10)
        a = M.adjusted_rand_index(c, "label", "cluster").select(F.lit(method).alias("method"), "ari")
        out = a if out is None else out.unionByName(a)
    return out


@reg("M10_M12_benchmark_by_sample")
def m12_by_sample(spark, sf):
    """ARI of k-means and Ward clusters against the clonotypes, by method, model and sample; k = number of clonotypes."""
    return cluster_benchmark(fx.repertoire(spark, sf))


@reg("M13_sweep_k")
def m13(spark, sf):
    """ARI by number of clusters, the best one marked."""
    sweep = ML.sweep_k(fx.vectors(spark, sf), "label", list(range(2, 20)))
    best = best_by(sweep, "ari", "k").select(F.col("k").alias("best_k"))
    return sweep.join(F.broadcast(best), F.col("k") == F.col("best_k"), "left").select("k", "ari", F.col("best_k").isNotNull().alias("is_best"))


@reg("M14_project_2d")
def m14(spark, sf):
    return ML.project_2d(fx.vectors(spark, sf))


@reg("M15_clonotype_classifier")
def m15(spark, sf):
    rep = fx.repertoire(spark, sf).select("seq_id", "raw_clonotype_id", "v_gene", "j_gene", F.length("hc_cdr3").alias("cdr3_length"), full_vdj("hc_").alias("sequence"))
    rep = multi_member(rep.filter(F.col("sequence").isNotNull()), "raw_clonotype_id", 2)
    p = ML.nearest_centroid(rep, "raw_clonotype_id", ["v_gene", "j_gene", "cdr3_length"])
    return p.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("label") == F.col("pred"), F.lit(False)).cast("double")).alias("accuracy"))


@reg("M16_binding_classifier")
def m16(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    c = fx.contigs(spark, sf).select("seq_id", fx.document_of("seq_id").alias("doc_id"), full_vdj().alias("sequence"))
    p = ML.sequence_classifier(c.filter(F.col("sequence").isNotNull()).join(lab, "doc_id"), "y", "sequence", "seq_id", eval_size=0.3)
    scored = p.select("label", F.col("prob")[1].alias("score"), "pred")
    return M.binary_metrics(scored, "label", "score", pred="pred")


@reg("M17_residue_classifier")
def m17(spark, sf):
    t = fx.token_labels(spark, sf, together=True).withColumn("y", (F.col("label") == "P").cast("int"))
    p = ML.residue_classifier(t, "seq_id", "pos", "aa", "y")
    return M.binary_metrics(p, "label", "score")


@reg("M17_H16_render_positive")
def m17_render(spark, sf):
    """Held-out heavy chains with the residues the classifier predicts positive, ``-`` elsewhere."""
    t = fx.token_labels(spark, sf, together=True).withColumn("y", (F.col("label") == "P").cast("int"))
    return ML.render_positive(ML.residue_classifier(t, "seq_id", "pos", "aa", "y"))
