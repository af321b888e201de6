"""Machine-learning jobs on tables with ``pyspark.ml``.

Features stay in the cluster as vectors; statistics that must be shared with
every row (means, standard deviations: one number per dimension) come back as
bounded arrays. Class balancing, splits and evaluation reuse the relational
operators (hash split, distributed ranking, E11-E17).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA, HashingTF, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.operators.corpus import hash_split, unit_hash
from clonalyze.operators.dedupe import rank_within
from clonalyze.operators.joins import null_safe_join
from clonalyze.functions.residues import mask_render
from clonalyze.operators.metrics import adjusted_rand_index
from clonalyze.session import cut_lineage, gathered, materialize, release

FITS_AT_ONCE = 4        # independent fits of one table
RFF_DIMS = 128


def encode_labels(df: DataFrame, col: str, out: str = "label_idx") -> DataFrame:
    """M1: labels -> 0..k-1 in alphabetical order of their text."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc").fit(df).transform(df)


def oversample(df: DataFrame, label: str, id: str, seed: str = "0") -> DataFrame:
    """M2: every class up to the majority size, with replacement: whole copies
    (``floor(max / n)`` via explode) plus a remainder chosen by hash order."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n")).first()[0]                       # one number
    c = null_safe_join(df, counts, [label])
    copies = F.floor(F.lit(top) / F.col("_n")).cast("int")
    whole = c.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    rest = c.withColumn("_h", unit_hash(F.lit(seed), F.col(id)))
    rest = rank_within(rest, [label], ["_h", id]).filter(F.col("_rank") <= F.lit(top) - copies * F.col("_n"))
    return whole.drop("_n").unionByName(rest.drop("_n", "_h", "_rank"))


def standardise(train: DataFrame, df: DataFrame, vec: str = "vec", with_mean: bool = True, with_std: bool = True,
                out: str = "vec_std") -> DataFrame:
    """M3: (x - mean) / population std, statistics from ``train`` only (one value per
    dimension, so they travel as literal arrays); a zero std leaves the value centred."""
    s = train.select(array_to_vector(vec).alias("_v")).select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = s["count"]
    mean = [float(x) for x in s["mean"]]
    std = [float((v * (n - 1) / n) ** 0.5) if n > 0 else 0.0 for v in s["variance"]]
    m_arr = F.array(*[F.lit(x) for x in mean])
    s_arr = F.array(*[F.lit(x) for x in std])
    return df.withColumn(out, F.zip_with(F.zip_with(F.col(vec), m_arr, lambda x, m: x - m if with_mean else x), s_arr,
                                         lambda x, sd: F.when(F.lit(with_std) & (sd > 0), x / sd).otherwise(x)))


def random_fourier_features(df: DataFrame, vec: str = "vec", dims: int = RFF_DIMS, gamma: float | None = None, seed: int = 42,
                            out: str = "rff") -> DataFrame:
    """M5 (RBF kernel): z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi),
    so that z(x).z(y) approximates exp(-gamma |x - y|^2); a linear model on z acts
    like an RBF-kernel model. W and b are D x d constants (bounded by the feature
    widths, not the data); the projection is one numpy product per Arrow batch."""
    d = len(df.select(vec).first()[0])
    gamma = gamma if gamma is not None else 1.0 / d
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, dims))
    b = rng.uniform(0.0, 2 * np.pi, size=dims)
    scale = float(np.sqrt(2.0 / dims))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy()) if len(v) else np.zeros((0, d))
        z = np.cos(x @ w + b) * scale
        return pd.Series(list(z))

    return df.withColumn(out, project(F.col(vec)))


def classifiers(n_features: int, n_classes: int, seed: int = 42) -> dict:
    """M4-M8: the five model families (MLP with one hidden layer of dims/2 nodes)."""
    hidden = max(2, n_features // 2)
    return {
        "neural_network": MultilayerPerceptronClassifier(layers=[n_features, hidden, n_classes], maxIter=3 * n_features, seed=seed),
        "svm": OneVsRest(classifier=LinearSVC(maxIter=50), parallelism=FITS_AT_ONCE),
        "svm_rbf": OneVsRest(classifier=LinearSVC(maxIter=50), parallelism=FITS_AT_ONCE),          # on random Fourier features
        "random_forest": RandomForestClassifier(numTrees=100, seed=seed),
        "naive_bayes": NaiveBayes(modelType="gaussian"),
        "logistic_regression": LogisticRegression(maxIter=100),
    }


def log_loss(scored: DataFrame, label: str = "label", prob: str = "probability") -> float | None:
    """Mean negative log probability of the true class (probabilities bounded away from 0); None without rows."""
    p = F.get(vector_to_array(prob), F.col(label).cast("int"))
    return scored.agg(F.avg(-F.ln(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-15))))).first()[0]


def fit_early_stopped(est: MultilayerPerceptronClassifier, train: DataFrame, id: str = "seq_id", step: int = 10, patience: int = 3,
                      min_delta: float = 1e-3, held_out: float = 0.2, seed: str = "42") -> tuple:
    """M4 with early stop: rounds of ``step`` iterations, each starting from the weights of the one before, watched on a
    hash share of the training rows.

    Stops once ``patience`` rounds in a row have not lowered the best validation loss by ``min_delta``, or after
    ``est``'s maxIter. Returns (model of the best round, [(round, loss, kept)]). Without validation rows it is one plain fit.
    """
    split = materialize(hash_split(train, id, [("watch", held_out), ("fit", 1 - held_out)], salt=f"{seed}:watch"))
    fit, watch = split.filter("split = 'fit'"), split.filter("split = 'watch'")
    rounds, best, history = max(1, -(-est.getMaxIter() // step)), None, []
    if watch.isEmpty() or fit.isEmpty():
        release(split)
        return est.fit(train), history
    warm = est.copy({est.maxIter: min(step, est.getMaxIter())})
    for n in range(rounds):
        model = warm.fit(fit)
        loss = log_loss(model.transform(watch))
        history.append((n, loss))
        if best is None or loss < best[1] - min_delta:
            best = (n, loss, model)
        elif n - best[0] >= patience:
            break
        warm = warm.copy({warm.initialWeights: model.weights})
    release(split)
    return best[2], [(n, loss, n == best[0]) for n, loss in history]


def compare_classifiers(df: DataFrame, label: str = "label", vec: str = "vec", id: str = "seq_id", eval_size: float = 0.1,
                        balancing: bool = False, scaling: bool = False, models: Sequence[str] | None = None,
                        seed: str = "42") -> DataFrame:
    """M9: fit every model on the same hash split and return long predictions
    (model, id, label, pred, prob array) for the held-out rows; evaluate with E11-E15."""
    split = hash_split(df, id, [("eval", eval_size), ("train", 1 - eval_size)], salt=seed)
    train, test = split.filter("split = 'train'"), split.filter("split = 'eval'")
    if balancing:
        train = oversample(train, label, id, seed)
    if scaling:
        test = standardise(train, test, vec, out=vec)
        train = standardise(train, train, vec, out=vec)
    n_features = len(df.select(vec).first()[0])
    n_classes = df.agg(F.max(label)).first()[0] + 1
    fam = classifiers(n_features, n_classes)
    out = None
    train, test = gathered(train, n_features), gathered(test, n_features)      # every model is fitted on the same kept rows
    for name in models or list(fam):
        est = fam[name]
        col = vec
        tr_src, te_src = train, test
        if name == "svm_rbf":   # projected once, kept for the iterative fits
            tr_src, te_src, col = gathered(random_fourier_features(train, vec), RFF_DIMS), random_fourier_features(test, vec), "rff"
        tr = tr_src.select(id, F.col(label).cast("double").alias("label"), array_to_vector(col).alias("features"))
        te = te_src.select(id, F.col(label).cast("double").alias("label"), array_to_vector(col).alias("features"))
        fitted = fit_early_stopped(est, tr, id, seed=seed)[0] if name == "neural_network" else est.fit(tr)
        pred = fitted.transform(te)
        if "probability" not in pred.columns:
            # margins -> probabilities: a multinomial regression of the training labels on the margins
            margins = fitted.transform(tr).select("label", F.col("rawPrediction").alias("margins"))
            scaler = LogisticRegression(featuresCol="margins", maxIter=50, predictionCol="_p", rawPredictionCol="_r").fit(margins)
            pred = scaler.transform(pred.withColumnRenamed("rawPrediction", "margins"))
        prob = vector_to_array("probability")
        p = pred.select(F.lit(name).alias("model"), id, F.col("label").cast("int").alias("label"),
                        F.col("prediction").cast("int").alias("pred"), prob.alias("prob"))
        p = cut_lineage(p)                                   # predicted once, whatever is evaluated on it
        if tr_src is not train:
            release(tr_src)
        out = p if out is None else out.unionByName(p)
    release(train, test)
    return out


def _width(df: DataFrame, vec: str) -> int:
    """Numbers of a vector; 1 without rows."""
    one = df.select(vec).first()
    return len(one[0] or ()) if one else 1


def _clusterer(method: str, k: int, seed: int = 42, out: str = "cluster") -> KMeans | BisectingKMeans:
    return {"kmeans": KMeans(k=k, seed=seed), "bisecting": BisectingKMeans(k=k, seed=seed)}[method].setPredictionCol(out)


def cluster(df: DataFrame, method: str, k: int, vec: str = "vec", seed: int = 42, out: str = "cluster") -> DataFrame:
    """K-means or bisecting k-means (the top-down hierarchical counterpart
    of agglomerative clustering) on vectors."""
    v = df.withColumn("features", array_to_vector(vec))
    return _clusterer(method, k, seed, out).fit(v).transform(v).drop("features")


def spectral(edges: DataFrame, k: int, src: str = "src", dst: str = "dst", weight: str = "weight", seed: int = 42) -> DataFrame:
    """M11 (spectral): power iteration clustering on a sparse affinity graph
    (e.g. kNN edges with similarity weights); returns (id, cluster)."""
    e = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.col(weight).cast("double").alias("weight"))
    return PowerIterationClustering(k=k, weightCol="weight", maxIter=20).assignClusters(e)


def sweep_k(df: DataFrame, truth: str, ks: Sequence[int], vec: str = "vec", method: str = "bisecting") -> DataFrame:
    """ARI against ``truth`` for every cluster count; one distributed fit per k.

    The rows are read once for all counts: every model adds its column, and a row a count, class and cluster is counted."""
    df = gathered(df.select(truth, vec), _width(df, vec))
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        models = list(pool.map(lambda k: _clusterer(method, k, out=f"_c{k}").fit(df.withColumn("features", array_to_vector(vec))), ks))
    rows = reduce(lambda x, m: m.transform(x), models, df.withColumn("features", array_to_vector(vec)))
    found = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("cluster")) for k in ks])
    counts = cut_lineage(rows.select(truth, F.inline(found)).groupBy("k", truth, "cluster").agg(F.count(F.lit(1)).alias("n")))
    release(df)
    return cut_lineage(adjusted_rand_index(counts, truth, "cluster", ["k"], count="n"))


def nearest_centroid(df: DataFrame, label: str, groups: Sequence[str], seq: str = "sequence", id: str = "seq_id", k: int = 3,
                     dims: int = 256, eval_size: float = 0.1, seed: str = "7") -> DataFrame:
    """M15 (re-aimed): a held-out sequence gets the class whose mean k-mer vector is nearest
    by cosine among the classes of its own ``groups`` (e.g. V gene, J gene and CDR3 length,
    inside which clonotypes are told apart). Classes may grow with the data: centroids are a
    table, nothing is fitted on the driver. Returns (id, label, pred); pred is null where
    the group has no class in the training rows. Sequences are dealt by group (null is a value like any other), and
    become vectors where they are averaged and compared; no vector is shuffled."""
    d = df.select(id, label, F.struct(*groups).alias("_g"), F.col(seq).alias("_s"))
    split = hash_split(d, id, [("eval", eval_size), ("train", 1 - eval_size)], salt=seed)

    def part(name: str) -> DataFrame:
        return kmer_features(split.filter(F.col("split") == name).drop("split").repartition("_g"), "_s", k, dims)

    mean = vector_to_array(Summarizer.mean(F.col("features")))
    centres = part("train").groupBy("_g", label).agg(mean.alias("_c")).withColumnRenamed(label, "_pred")
    both = part("eval").select(id, label, "_g", vector_to_array("features").alias("_x")).join(centres, "_g", "left")

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cosine = dot("_x", "_c") / F.sqrt(dot("_x", "_x") * dot("_c", "_c"))
    # a number a candidate goes into the aggregation, not its vectors
    near = both.select(id, label, "_pred", cosine.alias("_cos"))
    best = F.max_by("_pred", F.struct("_cos", F.hash("_pred")))
    return near.groupBy(id).agg(F.first(label).alias("label"), best.alias("pred"))


def project_2d(df: DataFrame, vec: str = "vec", id: str = "seq_id") -> DataFrame:
    """M14 (re-aimed): standardised vectors projected on the first two principal
    axes, each axis signed so that its largest loading is positive."""
    v = df.withColumn("features", array_to_vector(vec))
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=2, inputCol="scaled", outputCol="pc").fit(scaled)
    pcs = model.pc.toArray()
    signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(scaled).withColumn("_pc", vector_to_array("pc"))
    return out.select(id, (F.col("_pc")[0] * signs[0]).alias("x"), (F.col("_pc")[1] * signs[1]).alias("y"))


def kmer_features(df: DataFrame, seq: str = "sequence", k: int = 3, dims: int = 1 << 12) -> DataFrame:
    """Overlapping k-mers hashed into a sparse count vector (M15-M16 features)."""
    kmers = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(F.col(seq), i, k))
    return HashingTF(inputCol="_kmers", outputCol="features", numFeatures=dims).transform(df.withColumn("_kmers", kmers)).drop("_kmers")


def sequence_classifier(df: DataFrame, label: str, seq: str = "sequence", id: str = "seq_id", eval_size: float = 0.1,
                        seed: str = "7") -> DataFrame:
    """M16 (re-aimed): k-mer features + multinomial logistic regression,
    held-out rows by hash split; returns (id, label, pred, prob)."""
    d = kmer_features(df, seq).withColumn("_y", F.col(label).cast("double"))
    split = hash_split(d, id, [("eval", eval_size), ("train", 1 - eval_size)], salt=seed)
    model = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=50).fit(split.filter("split = 'train'"))
    p = model.transform(split.filter("split = 'eval'"))
    return p.select(id, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"),
                    vector_to_array("probability").alias("prob"))


def residue_classifier(tokens: DataFrame, seq_key: str = "seq_id", pos: str = "pos", aa: str = "aa", label: str = "y",
                       window: int = 2, eval_size: float = 0.2, seed: str = "11") -> DataFrame:
    """M17 (re-aimed): per-residue classifier on one-hot features of the residue and
    its +-``window`` neighbours (found by one sort, not by joins); returns (seq, pos, aa, label, score)."""
    from pyspark.ml.feature import OneHotEncoder

    from pyspark.sql.window import Window

    # one sort by sequence gives all neighbours; a sequence's positions are bounded by its length
    order = Window.partitionBy(seq_key).orderBy(pos)
    feats = tokens.select(seq_key, pos, aa, label, *[
        F.when(F.lag(pos, -off).over(order) == F.col(pos) + off, F.lag(aa, -off).over(order)).alias(f"_n{off}")
        for off in range(-window, window + 1) if off])
    cols = [aa] + [f"_n{o}" for o in range(-window, window + 1) if o != 0]
    feats = feats.na.fill("-", cols[1:])
    split = hash_split(feats, seq_key, [("eval", eval_size), ("train", 1 - eval_size)], salt=seed)
    # equal surroundings are one training row that weighs as many: at most as many rows as there are windows of letters
    train = cut_lineage(split.filter("split = 'train'").groupBy(*cols, F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in cols]
    ohe = OneHotEncoder(inputCols=[f"{c}_i" for c in cols], outputCols=[f"{c}_v" for c in cols])
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=[f"{c}_v" for c in cols], outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=50)
    model = Pipeline(stages=[*idx, ohe, asm, lr]).fit(train)
    # the margin is a sum of one number a letter and place, so rows are scored without vectors
    fitted, at, margin = model.stages[-1], 0, None
    held = split.filter("split = 'eval'")
    if fitted.numClasses > 2:
        return model.transform(held).select(seq_key, pos, aa, F.col(label).cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
    for c, i in zip(cols, model.stages):
        slots = fitted.coefficients.toArray()[at:at + len(i.labels)]
        at += len(i.labels)
        known = [F.lit(x) for letter, v in zip(i.labels, slots) for x in (letter, float(v))]
        own = F.coalesce(F.try_element_at(F.create_map(*known), F.col(c)), F.lit(0.0)) if known else F.lit(0.0)
        margin = own if margin is None else margin + own
    score = 1 / (1 + F.exp(-(margin + F.lit(float(fitted.intercept)))))
    return held.select(seq_key, pos, aa, F.col(label).cast("int").alias("label"), score.alias("score"))


def render_positive(scored: DataFrame, seq_key: str = "seq_id", pos: str = "pos", aa: str = "aa", score: str = "score") -> DataFrame:
    """M17 + H16: (seq, rendered, n_positive): residues predicted positive, ``-`` elsewhere, in order of position.

    One row of a sequence's residues is gathered, bounded by its length. Ties of the rounding go to even (H12).
    """
    hit = F.struct(F.col(pos).alias("pos"), F.col(aa).alias("aa"), F.bround(F.col(score), 0).cast("int").alias("p"))
    g = scored.groupBy(seq_key).agg(F.array_sort(F.collect_list(hit)).alias("_t"))
    return g.select(seq_key, mask_render(F.transform("_t", lambda x: x["aa"]), F.transform("_t", lambda x: x["p"])).alias("rendered"),
                    F.aggregate("_t", F.lit(0), lambda s, x: s + x["p"]).alias("n_positive"))
