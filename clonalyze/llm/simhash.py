"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of word shingles are linked when they differ in at most ``tau`` bits.
Bits are grouped into partitions (correlated bits together), and every partition i
gets its own threshold t_i >= -1 with ``sum(t_i) = tau - m + 1``: two fingerprints
within ``tau`` bits are then within t_i bits on at least one partition. The number
of partitions and the thresholds come from a dynamic programme over probe and
candidate counts estimated on a bounded sample of fingerprints; t = -1 skips a
partition, t >= 1 probes all values within t bits.

Entries meet in buckets (partition bits equal) and every pair of a bucket is
verified on all 64 bits; a bucket emits only a spanning forest of its links.
A bucket above ``BUCKET`` entries is never paired whole and never cut: its entries
move on to finer buckets, where the bits that they don't share yet are split into
``tau + 1`` groups, at least one of which any pair within ``tau`` bits shares, until
at most ``tau`` bits are left and the bucket is linked to its smallest. Buckets
that hold over a thousandth of all entries move on before the shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.llm.common import bounded_batches, hash_sample, hot_aware_lookup, plain_names, shuffle_partitions, staged

BITS = 64
SAMPLE = 4096      # fingerprints, about, on which partitions and thresholds are planned
BUCKET = 2048      # entries that one task compares with each other at once
_CHUNK = 1 << 14   # shingles unpacked at once


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles; 0 without words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        got = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: the identifier and ``fp`` (64 bits as a signed long)."""
    bounded_batches(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(rows, f"`{id_col}` {kind}, fp bigint")


# ---- planning -------------------------------------------------------------

def bit_groups(sample: np.ndarray, m: int, bits: list[int] | None = None) -> list[list[int]]:
    """``m`` groups of near-equal size, each grown by the bit most correlated with it."""
    bits = list(range(BITS)) if bits is None else bits
    x = ((sample[:, None] >> np.array(bits, np.uint64)) & np.uint64(1)).astype(float)
    x -= x.mean(0)
    sd = np.sqrt((x * x).mean(0))
    corr = np.abs(x.T @ x / max(1, len(x))) / np.maximum(np.outer(sd, sd), 1e-9)
    left, groups = set(range(len(bits))), []
    for g in range(m):
        size = len(bits) // m + (g < len(bits) % m)
        pool = sorted(left)
        own = [max(pool, key=lambda i: (corr[i, pool].sum(), -i))] if size else []
        left -= set(own)
        while len(own) < size:
            pool = sorted(left)
            best = max(pool, key=lambda i: (corr[i, own].sum(), -i))
            own.append(best)
            left.discard(best)
        groups.append(sorted(bits[i] for i in own))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def plan(sample: np.ndarray, rows: int, tau: int) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each partition that is probed, of the cheapest plan."""
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for m in range(1, tau + 3):
        groups = bit_groups(sample, m)
        budget = tau - m + 1
        cost = [[0.0] + [_cost(sample, rows, g, t) for t in range(0, tau + 1)] for g in groups]   # [i][t + 1]
        # f[s] = least cost of the partitions so far with thresholds that sum to s
        f: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i in range(m):
            g: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in f.items():
                for t in range(-1, tau + 1):
                    new = (c + cost[i][t + 1], ts + [t])
                    if s + t not in g or new[0] < g[s + t][0]:
                        g[s + t] = new
            f = g
        if budget in f and f[budget][0] < best[0]:
            best = (f[budget][0], [(mask_of(g), t) for g, t in zip(groups, f[budget][1], strict=True) if t >= 0])
    return best[1]


def _cost(sample: np.ndarray, rows: int, bits: list[int], t: int) -> float:
    """Estimated entries written plus candidates verified for one partition at threshold t."""
    w = len(bits)
    ball = sum(math.comb(w, j) for j in range(t + 1))
    part = sample & np.uint64(mask_of(bits))
    near = pairs = 0
    for at in range(0, len(part), 512):
        near += int((np.bitwise_count(part[at:at + 512, None] ^ part[None, :]) <= t).sum())
        pairs += len(part[at:at + 512]) * len(part)
    near, pairs = near - len(part), max(1, pairs - len(part))
    p = max(near / pairs, ball / 2.0 ** w)
    return rows * ball * 20.0 + rows * rows / 2 * p


# ---- probing and verifying --------------------------------------------------

def _entries(parts: list[tuple[int, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mask, value, fp) for every partition and every value within its threshold."""
    flips = []
    for mask, t in parts:
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips.append((np.uint64(mask), np.array([mask_of(list(c)) for j in range(t + 1) for c in itertools.combinations(bits, j)], np.uint64)))
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for mask, variants in flips:
            step = max(1, (1 << 16) // len(variants))
            for at in range(0, len(fp), step):
                own = fp[at:at + step]
                value = ((own & mask)[:, None] ^ variants[None, :]).ravel()
                yield _batch(np.full(len(value), mask), value, np.repeat(own, len(variants)))


def _batch(mask, value, fp) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (mask, value, fp)], names=["mask", "value", "fp"])


def _finer(tau: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of large buckets, once for each of tau + 1 groups of the bits not shared yet."""
    for b in batches:
        mask, value, fp = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
        for own in np.unique(mask):
            at = mask == own
            rest = [x for x in range(BITS) if not int(own) >> x & 1]     # more than tau
            for g in range(tau + 1):
                more = np.uint64(mask_of(rest[g::tau + 1]))
                yield _batch(np.full(at.sum(), own | more), value[at] | (fp[at] & more), fp[at])


def _spanning(fps: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most tau differing bits) among distinct fingerprints."""
    rest, links = np.unique(fps), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(rest ^ x) <= tau
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                links += [(x, y) for y in found]
                queue += list(found)
    return links


def _verify(tau: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries in; out: links (mask null) and the entries of buckets above BUCKET."""
    key, blocks, n, over = None, [], 0, False       # the bucket that goes on into the next batch

    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(3)])
        cut = np.flatnonzero((x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [x.shape[1]]])
        whole = (ends - starts > 1)
        whole[0] = whole[-1] = True
        links: list[tuple[int, int]] = []
        for a, z in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True):
            own = (x[0, a], x[1, a])
            if own != key:
                if n > 1 and not over:
                    links += _spanning(np.concatenate(blocks), tau)
                key, blocks, n, over = own, [], 0, False
            n += z - a
            if over:
                yield _batch(*x[:, a:z])
            else:
                blocks.append(x[2, a:z])
                if n > BUCKET:
                    fp = np.concatenate(blocks)
                    yield _batch(np.full(n, own[0]), np.full(n, own[1]), fp)
                    blocks, over = [], True
        if links:
            yield _links(links)
    if n > 1 and not over and (links := _spanning(np.concatenate(blocks), tau)):
        yield _links(links)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int64()), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["mask", "value", "fp"])


def near_links(fps: DataFrame, tau: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``fp`` values within ``tau`` bits of each other.

    The links span the same components as all pairs within ``tau`` bits.
    """
    spark = fps.sparkSession
    bounded_batches(spark)
    rows = fps.count()
    sample = hash_sample(fps.select("fp"), SAMPLE, rows, "fp")      # bounded, used for planning only
    got = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)
    parts = plan(got, rows, tau) if len(got) > 1 else [(mask_of(list(range(BITS))), 0)]
    schema = "mask bigint, value bigint, fp bigint"
    entries = fps.select("fp").mapInArrow(partial(_entries, parts), schema)
    found = None
    while True:
        level = staged(entries, "simhash-entries")
        total = level.count()
        if not total:
            break
        hot = (level.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > max(BUCKET, total // 1000)).select("mask", "value"))     # under 1000 rows
        hot = staged(hot, "simhash-hot")
        cold = level.join(F.broadcast(hot), ["mask", "value"], "left_anti").select("mask", "value", "fp")
        ordered = cold.repartition(shuffle_partitions(spark), "mask", "value").sortWithinPartitions("mask", "value", "fp")
        done = staged(ordered.mapInArrow(partial(_verify, tau), schema), "simhash-verified")
        links = done.filter(F.col("mask").isNull()).select(F.col("value").alias("a"), F.col("fp").alias("b"))
        found = links if found is None else found.unionByName(links)
        over = done.filter(F.col("mask").isNotNull()).unionByName(
            level.join(F.broadcast(hot), ["mask", "value"], "left_semi").select("mask", "value", "fp"))
        # with at most tau bits not shared, all of a bucket's (at most 2^tau) fingerprints are near each other
        alike = F.bit_count("mask") >= BITS - tau
        stars = over.filter(alike).groupBy("mask", "value").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
        found = found.unionByName(stars.select("a", F.explode("all").alias("b")).filter("a <> b"))
        over = over.filter(~alike)
        if over.isEmpty():
            break
        # every level shares more bits; an entry that several buckets pass on is kept once
        entries = over.mapInArrow(partial(_finer, tau), schema).distinct()
    return found if found is not None else spark.createDataFrame([], "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: ``node``, ``root`` (smallest node).

    Only nodes with a link appear. Every round is staged in the shared folder; rounds
    grow with the logarithm of the longest chain, and a round works on at most as many
    rows as there are links.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small, "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2) -> DataFrame:
    """One row per input row: identifier, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest identifier reachable over links of at most ``tau``
    bits, the row's own included. Null and empty texts have fingerprint 0 and are linked like
    any other. Null identifiers never name a component unless all its rows have none (then it is
    null). Repeated rows share a component. An empty table gives an empty result.
    """
    marked = staged(fingerprints(df, id_col, text_col, shingle).withColumnRenamed(id_col, "_id"), "simhash-fp")
    fps = staged(marked.groupBy("fp").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    total = marked.count()
    if not total:
        return marked.select(F.col("_id").alias(id_col), F.lit("").alias("fingerprint"), F.col("_id").alias("component_id"))
    roots = components(near_links(fps, tau))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    lookup = staged(placed.join(lows, "root").select("fp", "n", "component_id"), "simhash-component")
    out = hot_aware_lookup(marked, lookup, ["fp"], "n", total)
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2) -> DataFrame:
    """Exactly one row of each component: of the smallest identifier, nulls last; rows that tie are told apart by a row key.

    Rows are decided and removed by the row key, so null and repeated identifiers
    neither take other rows with them nor keep more than one row of a component.
    """
    plain, pos = plain_names(df)
    keyed = staged(plain.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")     # staged: the keys stay as they are
    own = F.col(pos[id_col])
    key = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("_row").alias("row"))
    marked = staged(fingerprints(keyed.select(key.alias("_key"), pos[text_col]), "_key", pos[text_col], shingle), "simhash-fp")
    fps = staged(marked.groupBy("fp").agg(F.min("_key").alias("low")), "simhash-distinct")
    roots = components(near_links(fps, tau))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("low", F.coalesce("root", "fp").alias("root"))
    kept = placed.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.row").alias("_row"))
    gone = staged(marked.select(F.col("_key.row").alias("_row")).join(kept, "_row", "left_anti"), "simhash-gone")
    return keyed.join(gone, "_row", "left_anti").select(*[F.col(pos[c]).alias(c) for c in df.columns])
