"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search.

The tree is fitted on a bounded sample of vectors (``SAMPLE``); every vector is indexed, in
the leaf it descends to. A query walks the tree through a priority queue, always opening
the nearest node next, and visits leaves in that order. How many leaves a query visits is
calibrated: against the exact neighbours of a sample of queries (found in blocks over all
vectors) the visits are widened until ``RECALL`` of the neighbours lie in visited leaves.

Equal vectors are one entry with its smallest identifiers, as many as any answer can need,
so a hot vector costs one row. Neighbouring leaves share a bin; a bin is cut into blocks of rows
and of queries, and a task holds one block of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonalyze.llm.common import bounded_batches, hash_sample, hot_aware_lookup, staged

SAMPLE = 20_000         # vectors, about, that the tree is fitted on
LEAF_ROWS = 512         # rows of a leaf aimed at
BRANCH = 8
CALIBRATION = 256       # queries, about, whose exact neighbours are found
RECALL = 0.98
BLOCK = 8192            # rows, and queries, of one block


@dataclass
class Node:
    centre: np.ndarray
    leaf: int = -1
    children: list[Node] = field(default_factory=list)


@dataclass
class Tree:
    root: Node
    leaves: int

    def leaf_order(self, unit: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of one unit vector, best bin first."""
        out: list[int] = []
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        tick = 0
        while queue and len(out) < visits:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                out.append(node.leaf)
                continue
            near = np.stack([c.centre for c in node.children]) @ unit
            for s, c in zip(near.tolist(), node.children, strict=True):
                tick += 1
                heapq.heappush(queue, (-s, tick, c))
        return out

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units), np.int32)

        def descend(node: Node, rows: np.ndarray) -> None:
            if not node.children:
                out[rows] = node.leaf
                return
            best = (units[rows] @ np.stack([c.centre for c in node.children]).T).argmax(1)
            for i, c in enumerate(node.children):
                if (best == i).any():
                    descend(c, rows[best == i])

        if len(units):
            descend(self.root, np.arange(len(units)))
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / big      # no overflow or underflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_tree(units: np.ndarray, leaf_rows: float, seed: int = 7) -> Tree:
    """Hierarchical spherical k-means; a node with at most ``leaf_rows`` sample rows is a leaf."""
    rng, n_leaves = np.random.default_rng(seed), 0

    def split(rows: np.ndarray, centre: np.ndarray) -> Node:
        nonlocal n_leaves
        node, x = Node(centre), units[rows]
        if len(rows) > leaf_rows and len(rows) >= BRANCH:
            centres = x[rng.choice(len(x), BRANCH, replace=False)]
            for _ in range(12):
                part = (x @ centres.T).argmax(1)
                sums = np.stack([x[part == i].sum(0) for i in range(BRANCH)])
                norm = np.sqrt((sums * sums).sum(1, keepdims=True))
                centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
            part = (x @ centres.T).argmax(1)
            filled = [i for i in range(BRANCH) if (part == i).any()]
            if len(filled) > 1:
                node.children = [split(rows[part == i], centres[i]) for i in filled]
                return node
        node.leaf, n_leaves = n_leaves, n_leaves + 1
        return node

    root = split(np.arange(len(units)), np.zeros(units.shape[1]))
    return Tree(root, n_leaves)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for the same pair wherever it is computed."""
    ua, ub = np.abs(a).max(axis=-1, keepdims=True), np.abs(b).max(axis=-1, keepdims=True)
    a, b = a / ua, b / ub
    return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(queries: np.ndarray, visits: list[list[int]], rows: np.ndarray, leaf: np.ndarray, ids: list[list[int]], keep: int) -> Iterator[tuple[int, list]]:
    """The ``keep`` best (-score, identifier) of every query among the rows of the leaves that it visits."""
    q_units, r_units = unit(queries), unit(rows)
    by_leaf: dict[int, list[int]] = {}
    for q, own in enumerate(visits):
        for x in own:
            by_leaf.setdefault(x, []).append(q)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for x, asking in by_leaf.items():
        at = np.flatnonzero(leaf == x)
        for part in np.array_split(np.array(asking), -(-len(asking) // 512)) if len(at) else ():
            near = q_units[part] @ r_units[at].T
            kth = np.partition(near, len(at) - keep, axis=1)[:, len(at) - keep] if len(at) > keep else np.full(len(near), -np.inf)
            q, r = np.nonzero(near >= kth[:, None] - 1e-9)      # near ties are settled by the exact score
            pairs.append((part[q], at[r]))
    if not pairs:
        return
    which, cand = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(which, kind="stable")
    which, cand = which[order], cand[order]
    starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    for a, z in zip(starts, np.append(starts[1:], len(which)), strict=True):
        own = cand[a:z]
        score = cosine(queries[which[a]][None, :], rows[own])
        # every identifier of the answer is in a class that scores at least the keep-th best class
        least = np.partition(score, len(score) - keep)[len(score) - keep] if len(score) > keep else -np.inf
        yield int(which[a]), sorted((-score[o], i) for o in np.flatnonzero(score >= least) for i in ids[own[o]])[:keep]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest other rows by cosine of every row where ``is_query`` holds.

    Returns query_id, rank (from 1), vec_id, score. Nearest first, ties to the smaller
    identifier; fewer than ``k`` rows if there are fewer candidates. Null identifiers and
    vectors that aren't ``usable`` take no part, nor do vectors of another dimension than the
    commonest. Rows that repeat identifier and vector count once. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if dims is None:
        return empty
    rows = rows.filter(F.size("vec") == dims["d"]).withColumn("h", F.xxhash64("vec")).distinct()
    by_vec = Window.partitionBy("h", "vec").orderBy("vec_id")
    # of equal vectors the k + 1 smallest identifiers: no answer needs another one
    first = rows.withColumn("r", F.row_number().over(by_vec)).filter(F.col("r") <= k + 1)
    classes = (first.groupBy("h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "ann-classes")
    asked = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "h", F.col("vec").alias("q_vec"))
    n_by = staged(asked.groupBy("h", "q_vec").agg(F.count(F.lit(1)).alias("n")), "ann-asked")
    queries = staged(n_by.join(classes.select("h", "vec", "cid"), (n_by["h"] == classes["h"]) & (F.col("q_vec") == F.col("vec")))
                     .select("cid", n_by["h"].alias("h"), "vec", "n"), "ann-queries")
    total = classes.count()
    sample = _matrix(hash_sample(classes, SAMPLE, total, "h").select("vec").toArrow().column(0))
    tree = fit_tree(unit(sample), max(8.0, LEAF_ROWS * len(sample) / total))
    shared = spark.sparkContext.broadcast(tree)     # at most SAMPLE / 8 leaves

    def in_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaf_of(unit(_matrix(b.column("vec"))))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], names=["leaf", *b.schema.names])

    indexed = staged(classes.select("cid", "vec", "ids").mapInArrow(in_leaves, "leaf int, cid bigint, vec array<double>, ids array<bigint>"), "ann-leaves")
    visits = _calibrated(indexed, queries, tree, k, recall)
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}      # a row per leaf

    # neighbouring leaves share a bin of about BLOCK rows; a query comes once to each bin it has leaves in
    bin_of, filled = {}, BLOCK
    for leaf in range(tree.leaves):
        if filled + sizes.get(leaf, 0) > BLOCK:
            filled = 0
            new = len(set(bin_of.values()))
        bin_of[leaf] = new
        filled += sizes.get(leaf, 0)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, bins, leaves = [], [], []
            for i, u in enumerate(unit(_matrix(b.column("vec")))):
                own: dict[int, list[int]] = {}
                for leaf in shared.value.leaf_order(u, visits):
                    own.setdefault(bin_of[leaf], []).append(leaf)
                which += [i] * len(own)
                bins += list(own)
                leaves += list(own.values())
            part = b.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), *part.columns], names=["bin", "leaves", *b.schema.names])

    sent = staged(queries.select("cid", "vec").mapInArrow(to_bins, "bin int, leaves array<int>, cid bigint, vec array<double>"), "ann-sent")
    asking = {r["bin"]: r["count"] for r in sent.groupBy("bin").count().collect()}       # a row per bin
    rows_of: dict[int, int] = {}
    for leaf, n in sizes.items():
        rows_of[bin_of[leaf]] = rows_of.get(bin_of[leaf], 0) + n
    plan = F.create_map(*[x for i in set(bin_of.values()) for x in (F.lit(i), F.struct(
        F.lit(-(-rows_of.get(i, 0) // BLOCK)).alias("blocks"), F.lit(-(-asking.get(i, 0) // BLOCK)).alias("chunks")))])
    to_bin = F.create_map(*[x for leaf, i in bin_of.items() for x in (F.lit(leaf), F.lit(i))])
    own = F.xxhash64("cid")
    cut = indexed.withColumn("bin", to_bin[F.col("leaf")]).withColumn("p", plan[F.col("bin")]).filter("p.chunks > 0")
    cut = (cut.withColumn("block", F.pmod(own, F.col("p.blocks").cast("long")))
           .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.chunks").cast("long") - 1))).drop("p"))
    sent = sent.withColumn("p", plan[F.col("bin")]).filter("p.blocks > 0")
    sent = (sent.withColumn("chunk", F.pmod(own, F.col("p.chunks").cast("long")))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.blocks").cast("long") - 1))).drop("p"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["cid", "vec_id", "score"]
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            cids = left.column("cid").to_pylist()
            for j, found in _best(_matrix(left.column("vec")), left.column("leaves").to_pylist(), _matrix(right.column("vec")),
                                  right.column("leaf").to_numpy(), right.column("ids").to_pylist(), k + 1):
                for s, i in found:
                    out[0].append(cids[j])
                    out[1].append(i)
                    out[2].append(-s)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    keys = ["bin", "block", "chunk"]
    found = sent.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInArrow(nearest, "cid bigint, vec_id bigint, score double")
    best = Window.partitionBy("cid").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = top.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    lookup = staged(queries.join(lists, "cid").select("h", F.col("vec").alias("q_vec"), "n", "near"), "ann-answers")
    n_asked = asked.count()
    told = hot_aware_lookup(asked, lookup, ["h", "q_vec"], "n", n_asked)
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (told.select("query_id", F.posexplode(kept).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))


def _calibrated(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that ``recall`` of the exact neighbours of sampled queries are in them."""
    spark = indexed.sparkSession
    picked = hash_sample(queries, CALIBRATION, queries.count(), "h").select("cid", "vec").toArrow()
    if picked.num_rows < 20:
        return tree.leaves
    q, cids = _matrix(picked.column("vec")), picked.column("cid").to_pylist()
    shared = spark.sparkContext.broadcast((unit(q), cids))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, own = shared.value
        for b in batches:
            x = unit(_matrix(b.column("vec")))
            if not len(x):
                continue
            near = units @ x.T
            cid, leaf = b.column("cid").to_numpy(), b.column("leaf").to_numpy()
            near[np.array(own)[:, None] == cid[None, :]] = -2.0
            top = np.argsort(-near, axis=1)[:, :k]
            which = np.repeat(np.arange(len(units)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(leaf[top.ravel()]), pa.array(near[which, top.ravel()])],
                                             names=["q", "leaf", "score"])

    found = indexed.select("leaf", "cid", "vec").mapInArrow(exact, "q int, leaf int, score double")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "leaf")
    true = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "leaf").collect()   # k rows a sampled query
    orders = [{leaf: i for i, leaf in enumerate(tree.leaf_order(u, tree.leaves))} for u in unit(q)]
    places = np.sort([orders[r["q"]][r["leaf"]] for r in true])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1
