"""Prefix trie of conversations by van Emde Boas recursion.

The depths 0 .. 2^k - 1 are cut at half depth. A sequence that reaches the cut gets the name of its
first half, which is a node of the trie; the upper trie ends at the cut, and every name is the root of a lower
trie of what follows it. Upper and lower tries are built in the same way, all of one size in the
same step: a step of half size s names all depths d that are odd multiples of s, from the name at d - s
and the digest of the s turns between. So the trie takes as many steps as the logarithm of its depth, and
no step looks at a sequence longer than s.

Totals are grafted upward in the opposite order: in the step of half size s, every node at a cut
knows its total over the s depths from it on, and gives it to its ancestors in the upper trie, which
know theirs above the cut.

A node's name is its smallest member. Halves are told apart by two independent 64-bit hashes of role,
text and position, combined by exclusive or, beside the name of their root; turns are therefore neither
sorted nor gathered for them. Names common to many sequences (the first turn that a third of all
have) are counted before the shuffle and looked up by broadcast of the at most a thousand hottest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.llm.common import bounded_batches, hot_aware_lookup, shuffle_partitions, staged
from clonalyze.operators.dedupe import rank_within

CHUNK = 4096        # identifiers joined to one text before they are hashed


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, t, role, text): the turns of every conversation, numbered from 1 by turn (null first), ties by role, then text.

    Null roles and texts count as empty; rows without a conversation identifier belong to none and are left out.
    """
    src = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                    *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    return rank_within(src.filter(F.col("conv").isNotNull()), "conv", ["turn", "role", "text"], "t").select("conv", "t", "role", "text")


def named(seq: DataFrame, root: object, top: int) -> DataFrame:
    """(c, d, name): the node of every sequence at every depth from 1 on; ``top`` is a power of two above the greatest depth."""
    names = None
    half = top // 2
    while half:
        size = 2 * half
        cut = F.floor((F.col("t") - 1) / size) * size + half
        parts = (seq.filter(F.pmod(F.col("t") - 1, F.lit(size)) < half).select("c", cut.cast("long").alias("d"), "x", "y")
                 .groupBy("c", "d").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") == half).drop("n"))         # sequences that reach the cut
        if names is None:
            parts = parts.withColumn("root", F.lit(root))
        else:
            up = names.select(F.col("c").alias("_c"), F.col("d").alias("_d"), F.col("name").alias("root"))
            parts = (parts.join(up, (F.col("c") == F.col("_c")) & (F.col("d") - half == F.col("_d")), "left")
                     .select("c", "d", "x", "y", F.coalesce("root", F.lit(root)).alias("root")))
        parts = staged(parts, "trie-halves")
        heads = staged(parts.groupBy("d", "root", "x", "y").agg(F.min("c").alias("name"), F.count(F.lit(1)).alias("k")), "trie-names")
        found = staged(hot_aware_lookup(parts, heads, ["d", "root", "x", "y"], "k", max(1, parts.count())).select("c", "d", "name"), "trie-named")
        names = found if names is None else names.unionByName(found)
        half //= 2
    return names


def grafted(nodes: DataFrame, names: DataFrame, root: object, top: int) -> DataFrame:
    """(d, name, leaves, saved) summed over every node's subtree, from the nodes' own ``leaves`` and ``saved``."""
    totals = nodes.select("d", "name", "leaves", "saved")
    up = names.select(F.col("c").alias("_c"), F.col("d").alias("_d"), F.col("name").alias("over"))
    half = 1
    while half < top:
        below = (totals.filter(F.pmod(F.col("d"), F.lit(2 * half)) == half)
                 .select("name", F.explode(F.sequence(F.col("d") - half, F.col("d") - 1)).alias("at"), "leaves", "saved"))
        gained = (below.join(up, (F.col("name") == F.col("_c")) & (F.col("at") == F.col("_d")), "left")
                  .groupBy("at", F.coalesce("over", F.lit(root)).alias("over")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))
        totals = staged(totals.join(gained, (F.col("d") == F.col("at")) & (F.col("name") == F.col("over")), "left")
                        .select("d", "name", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")),
                        "trie-totals")
        half *= 2
    return totals


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and number in; out: one digest a node."""
    key, state = None, None
    for b in batches:
        d, name, ids = (b.column(i) for i in range(3))
        out: list[tuple] = []
        for i, text in enumerate(ids.to_pylist()):
            own = (d[i].as_py(), name[i].as_py())
            if own != key:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield _nodes(out, b)
        last = b
    if state:
        yield _nodes([(*key, state.hexdigest())], last)


def _nodes(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], like.column(0).type), pa.array(cols[1], like.column(1).type), pa.array(cols[2], pa.string())],
                                      names=["d", "name", "sha"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(d, name, sha): SHA-256 of the node's ``c``, ascending, in decimal, comma-joined.

    Sorting and joining spread over range partitions. A digest is sequential by its nature: a node of over
    ``CHUNK`` identifiers is hashed by one task, in constant memory, from joined chunks.
    """
    spark = ends.sparkSession
    bounded_batches(spark)
    ranked = rank_within(ends, ["d", "name"], "c", "r")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    chunks = staged(ranked.groupBy("d", "name", F.floor((F.col("r") - 1) / CHUNK).alias("chunk")).agg(joined.alias("ids"), F.max("r").alias("r")), "trie-ends")
    one = chunks.filter("chunk = 0").filter(F.col("r") < CHUNK).select("d", "name", F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))
    # a full first chunk may have others
    big = chunks.filter("chunk = 0").filter(F.col("r") >= CHUNK).select(F.col("d").alias("_d"), F.col("name").alias("_n"))
    many = chunks.join(big, (F.col("d") == F.col("_d")) & (F.col("name") == F.col("_n"))).select("d", "name", "ids", "chunk")
    many = many.repartition(shuffle_partitions(spark), "d", "name").sortWithinPartitions("d", "name", "chunk").select("d", "name", "ids")
    kinds = {f.name: f.dataType.simpleString() for f in ends.schema}
    return one.unionByName(many.mapInArrow(_digests, f"d {kinds['d']}, name {kinds['name']}, sha string"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of sequences.

    ``turns`` has (conv, t, role, text), t from 1 without gaps within a conversation; ``members`` has every
    ``conv`` once, those without turns too. Conversations are told apart by their long identifier. A node of depth d is a distinct sequence
    of d first (role, text); the root has depth 0. Returned: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (the parent's conv_id, null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the
    subtree, itself included), ``saved_tokens`` (over the subtree, members less one times the UTF-8 bytes of the last text),
    ``ends_sha256`` (of the members that end here, ascending, comma-joined).

    Empty roles and texts are turns like any other; equal sequences share all their nodes; very long texts
    only enter their hashes and lengths. Without members there is no node.
    """
    turns = turns.select(F.col("conv").alias("c"), F.col("t").cast("long").alias("t"), "role", "text")
    seq = staged(turns.select("c", "t", F.xxhash64(F.lit(1), "t", "role", "text").alias("x"), F.xxhash64(F.lit(2), "t", "role", "text").alias("y"),
                              F.octet_length("text").cast("long").alias("bytes")), "trie-turns")
    sizes = seq.groupBy("c").agg(F.max("t").alias("n"))
    convs = staged(members.select(F.col("conv").alias("c")).join(sizes, "c", "left").select("c", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "trie-members")
    root, total, deepest = convs.agg(F.min("c"), F.count(F.lit(1)), F.max("n")).first()
    kind = convs.schema["c"].dataType.simpleString()
    top = 1 << int(deepest or 0).bit_length()       # the first power of two above the greatest depth
    names = named(seq, root, top) if top > 1 else seq.select("c", F.col("t").alias("d"), F.col("c").alias("name")).limit(0)

    counted = names.groupBy("d", "name").agg(F.count(F.lit(1)).alias("n"))
    last = seq.select(F.col("c").alias("_c"), F.col("t").alias("_t"), "bytes")
    up = names.select(F.col("c").alias("_pc"), F.col("d").alias("_pd"), F.col("name").alias("parent"))
    nodes = (counted.join(last, (F.col("name") == F.col("_c")) & (F.col("d") == F.col("_t")))
             .join(up, (F.col("name") == F.col("_pc")) & (F.col("d") - 1 == F.col("_pd")), "left")
             .select("d", "name", "n", "bytes", F.coalesce("parent", F.lit(root)).cast(kind).alias("parent")))
    spark = seq.sparkSession
    top_row = spark.range(1 if total else 0).select(F.lit(0).cast("long").alias("d"), F.lit(root).cast(kind).alias("name"), F.lit(total).cast("long").alias("n"),
                                                     F.lit(0).cast("long").alias("bytes"), F.lit(None).cast(kind).alias("parent"))
    nodes = staged(nodes.unionByName(top_row), "trie-nodes")
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("cd"), F.col("parent").alias("cn")).agg(F.count(F.lit(1)).alias("children"))
    nodes = staged(nodes.join(children, (F.col("d") == F.col("cd")) & (F.col("name") == F.col("cn")), "left")
                   .select("d", "name", "n", "parent", F.coalesce("children", F.lit(0)).alias("children"),
                           F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "trie-nodes")
    totals = grafted(nodes, names, root, top).select(F.col("d").alias("td"), F.col("name").alias("tn"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))

    at = names.select(F.col("c").alias("_c"), F.col("d").alias("_d"), "name")
    ends = convs.join(at, (F.col("c") == F.col("_c")) & (F.col("n") == F.col("_d")), "left").select(F.col("n").alias("d"), F.coalesce("name", F.lit(root)).cast(kind).alias("name"), "c")
    shas = id_digests(ends).select(F.col("d").alias("sd"), F.col("name").alias("sn"), "sha")
    return (nodes.join(totals, (F.col("d") == F.col("td")) & (F.col("name") == F.col("tn")))
            .join(shas, (F.col("d") == F.col("sd")) & (F.col("name") == F.col("sn")), "left")
            .select(F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                    F.col("children").alias("n_children"), F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"),
                    F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
