"""Substring deduplication by seed and extend.

Anchors: of every window of ``length`` words, the smallest hash of its ``SEED``-word factors
(the rightmost of equals) is selected, so that windows of equal words select the same factor at the same
offset. A selected factor with the run of windows that select it is an occurrence; on average
there is one for twenty words. Occurrences of different documents are joined on the anchor.

Extension: an occurrence also carries a hash of the whole context that its windows span. If an
anchor has one context, its documents agree on all of it and nothing needs a second look. An anchor
with several contexts is a place where a repeat may end: one occurrence of every context
is extended to the left and to the right, a word at a time, by running sums of word hashes over the texts,
and meets the others at every extension that its windows allow. That is an aggregation, not a pair of
rows: a passage in a million documents costs a million rows, however the texts around it differ.

Kept are the maximal repeats: neighbouring matched windows of one text and one source merge.

Equal texts (by SHA-256 of their words) are collapsed first and answered from one of them. Within
an anchor, contexts and extensions are told apart by 64 bits each, beside the anchor's own 64 bits.
Hot anchors and hot texts are aggregated before the shuffle, and looked up by broadcast of the
at most a thousand hottest keys. Every stage is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.llm.common import bounded_batches, hot_aware_lookup, staged

LENGTH = 50     # words in a window
SEED = 10       # words in an anchor's factor
_ROWS = 4096    # occurrences whose contexts are summed at once
_VOCABULARY = 1 << 18


@cache
def _multipliers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers of the word positions."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Hashes of words, remembered for a bounded number of them."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _VOCABULARY:
            self.known = {}
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w, 11)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def selected(h: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash of every factor, position of the factor that every window selects)."""
    n = len(h) - seed + 1
    sums = np.zeros(n, np.uint64)
    for j, c in enumerate(_multipliers(seed, 1)):
        sums += h[j:j + n] * c
    g = _mixed(sums)
    at, span, want = np.arange(n), 1, length - seed + 1      # at[i]: smallest of span factors from i on, rightmost of equals

    def better(a, b):
        return np.where(g[a] < g[b], a, b)

    while span * 2 <= want:
        at = better(at[:-span], at[span:])
        span *= 2
    if span < want:
        at = better(at[:len(at) - (want - span)], at[want - span:])
    return g, at


def occurrences(h: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(anchor, context, position, first window, last window) of every selected factor of a text."""
    if len(h) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    g, at = selected(h, length, seed)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    p = at[first]
    context = np.empty(len(p), np.uint64)
    for i in range(0, len(p), _ROWS):
        s = slice(i, i + _ROWS)
        sums = _around(h, p[s], length, seed)
        row = np.arange(len(p[s]))
        reach = length - seed
        context[s] = sums[row, last[s] + length - p[s] + reach] - sums[row, first[s] - p[s] + reach]
    # contexts of other extents are other contexts
    context = _mixed(context + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - p + length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return g[p], context, p, first, last


def _around(h: np.ndarray, p: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Running sums of the hashes of the words around every position, from length - seed words before it."""
    reach = length - seed
    rel = np.arange(-reach, length)
    pos = p[:, None] + rel[None, :]
    inside = (pos >= 0) & (pos < len(h))
    terms = np.where(inside, h[np.clip(pos, 0, len(h) - 1)] * _multipliers(len(rel), 2)[None, :], np.uint64(0))
    return np.concatenate([np.zeros((len(p), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def extensions(h: np.ndarray, p: int, first: int, last: int, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """Hash of each of the windows ``first`` .. ``last``: the anchor at ``p`` with the words that extend it on both sides."""
    sums = _around(h, np.array([p]), length, seed)[0]
    at = np.arange(first, last + 1) - p + length - seed
    return sums[at + length] - sums[at]


def _marks(length: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = Words()
    kind = pa.list_(pa.struct([("a", pa.int64()), ("v", pa.int64()), ("p", pa.int32()), ("s0", pa.int32()), ("s1", pa.int32())]))
    for b in batches:
        digest, n, offsets, parts = [], [], [0], []
        for raw in b.column(1).cast(pa.binary()).to_pylist():
            words = (raw or b"").split()
            digest.append(hashlib.sha256(b" ".join(words)).digest())
            n.append(len(words))
            got = occurrences(words_of.hashes(words) if len(words) >= length else np.zeros(0, np.uint64), length, seed)
            parts.append(got)
            offsets.append(offsets[-1] + len(got[0]))
        cols = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0) for i in range(5)]
        flat = pa.StructArray.from_arrays([pa.array(c.view(np.int64)) for c in cols[:2]] + [pa.array(c.astype(np.int32)) for c in cols[2:]],
                                          fields=list(kind.value_type))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()),
                                          pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["id", "digest", "n", "anchors"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digest = [hashlib.sha256(b" ".join((raw or b"").split())).digest() for raw in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary())], names=["id", "text", "digest"])


def _extended(length: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, id, a, o, x, s): the extensions of the anchors that have to be extended."""
    words_of = Words()
    for b in batches:
        for i, (w, raw, hits) in enumerate(zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True)):
            todo = [t for t in hits if t["extend"]]
            if not todo:
                continue
            h = words_of.hashes(raw.split())
            for at in range(0, len(todo), _ROWS):
                part = todo[at:at + _ROWS]
                xs = [extensions(h, t["p"], t["s0"], t["s1"], length, seed) for t in part]
                n = [len(x) for x in xs]
                starts = np.concatenate([np.arange(t["s0"], t["s1"] + 1) for t in part])
                offset = np.repeat([t["p"] for t in part], n) - starts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), w, np.int64)), b.column(0).slice(i, 1).take(pa.array(np.zeros(len(starts), np.int64))),
                     pa.array(np.repeat(np.array([t["a"] for t in part], np.int64), n)), pa.array(offset.astype(np.int32)),
                     pa.array(np.concatenate(xs).view(np.int64)), pa.array(starts.astype(np.int32))], names=["w", "id", "a", "o", "x", "s"])


def merged(spans: list[tuple[int, int, object]], length: int) -> list[tuple[int, int, object]]:
    """Maximal repeats (first word, end, source) of matched windows (first, last, source)."""
    out: list[tuple[int, int, object]] = []
    for s0, s1, src in sorted(spans, key=lambda t: (str(t[2]), t[0], t[1])):
        if out and out[-1][2] == src and s0 <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], s1), src)
        else:
            out.append((s0, s1, src))
    return sorted(((a, z + length, src) for a, z, src in out), key=lambda t: (t[0], t[1], str(t[2])))


def _cut(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n_removed, kept text, repeats) of texts with matched windows."""
    for b in batches:
        gone, kept, repeats = [], [], []
        for raw, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = raw.split()
            found = merged([(t["s0"], t["s1"], t["src"]) for t in spans], length)
            step = np.zeros(len(words) + 1, np.int64)
            for a, z, _ in found:
                step[a] += 1
                step[z] -= 1
            stay = np.cumsum(step[:-1]) == 0
            gone.append(len(words) - int(stay.sum()))
            kept.append(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]))
            repeats.append([{"start": a, "end": z, "src": src} for a, z, src in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("src", b.column(2).type.value_type.field("src").type)]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(repeats, kind)],
                                         names=["digest", "n_removed", "kept", "repeats"])


def _looked_up(big: DataFrame, lookup: DataFrame, keys: list[str], total: int, own: list[str], share: int = 1000) -> DataFrame:
    """Left join of ``big`` with ``lookup`` (one row a key, ``k`` = rows of ``big`` with it); adds its other columns.

    The at most ``share`` keys that hold over ``total / share`` rows are broadcast. Their rows meet nothing in the
    shuffle join of the rest, and are dealt out there by ``own``, which tells rows apart.
    """
    values = [c for c in lookup.columns if c not in keys]
    hot = F.broadcast(lookup.filter(F.col("k") > total / share).select(*[F.col(c).alias(f"_h_{c}") for c in lookup.columns]))
    rest = lookup.filter(F.col("k") <= total / share).select(*[F.col(c).alias(f"_r_{c}") for c in lookup.columns], F.lit(0).cast("long").alias("_r_place"))
    first, others = keys[0], keys[1:]
    hit = F.col("_h_k").isNotNull()
    marked = (big.join(hot, [F.col(c) == F.col(f"_h_{c}") for c in keys], "left")
              .withColumn("_first", F.when(~hit, F.col(first))).withColumn("_place", F.when(hit, F.xxhash64(*own)).otherwise(0)))
    return (marked.join(rest, [F.col("_first") == F.col(f"_r_{first}"), F.col("_place") == F.col("_r_place"), *[F.col(c) == F.col(f"_r_{c}") for c in others]], "left")
            .select(*big.columns, *[F.coalesce(f"_h_{v}", f"_r_{v}").alias(v) for v in values]))


def _repeated(low, high, nulls):
    """Occurrences of at least two documents of different order (null identifiers come last)."""
    return low.isNotNull() & ((high > low) | (nulls > 0))


def _later(id_col, low):
    """The row's identifier comes after ``low``; null comes last."""
    return low.isNotNull() & (id_col.isNull() | (id_col > low))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: identifier, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept``, ``repeats``.

    A word is removed if a window of ``length`` consecutive words that covers it also starts in
    a row with a smaller identifier. Words are maximal runs outside white space (0x20, 0x09-0x0D), compared as
    they are. ``kept`` are the words that stay, joined by one space, in rows that lose words and whose text no row with a
    smaller identifier has (others: null, as they keep all or nothing); ``kept_sha256`` digests what stays in every row. ``repeats``
    are the maximal repeats (start, end exclusive, src: a smaller identifier that has all of it), null where ``kept`` is.

    Null and empty texts have no words. Null identifiers come after all others: they lose what
    any identified row has, and take nothing from a row. Rows of equal identifiers take nothing
    from each other. Texts shorter than ``length`` words lose nothing. An empty table gives an empty result.
    """
    if not 1 <= seed <= length:
        raise ValueError("an anchor lies within a window")
    spark = df.sparkSession
    bounded_batches(spark)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    marks = staged(src.mapInArrow(partial(_marks, length, seed),
                                  f"id {kind}, digest binary, n bigint, anchors array<struct<a:bigint,v:bigint,p:int,s0:int,s1:int>>"), "substring-marks")
    # one row per text, numbered: copies share its anchors
    texts = marks.groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("anchors").alias("anchors"))
    texts = staged(texts.withColumn("w", F.monotonically_increasing_id()), "substring-texts")
    occ = texts.select("w", F.col("low").alias("id"), F.explode("anchors").alias("o")).select("w", "id", "o.*")

    # seeds: anchors of several documents
    nulls = F.count_if(F.col("id").isNull())
    seeds = (occ.groupBy("a").agg(F.min("id").alias("m"), F.max("id").alias("h"), nulls.alias("z"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count(F.lit(1)).alias("k"))
             .filter(_repeated(F.col("m"), F.col("h"), F.col("z"))))
    seeds = staged(seeds.select("a", "m", (F.col("v0") != F.col("v1")).alias("several"), "k"), "substring-seeds")
    total = texts.agg(F.sum(F.size("anchors"))).first()[0] or 1
    hits = staged(_looked_up(occ, seeds, ["a"], total, ["w", "p"]).filter(F.col("k").isNotNull()).drop("k"), "substring-hits")

    # anchors with one context: their documents agree on all its windows
    agreed = hits.filter(~F.col("several") & _later(F.col("id"), F.col("m")))
    # several contexts: agreed within a context, and the first of each context is extended
    open_ = hits.filter("several").drop("m", "several")
    contexts = staged(open_.groupBy("a", "v").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("k")), "substring-contexts")
    judged = staged(_looked_up(open_, contexts, ["a", "v"], total, ["w", "p"]), "substring-judged")
    agreed = agreed.select("w", "s0", "s1", F.col("m").alias("src")).unionByName(
        judged.filter(_later(F.col("id"), F.col("m"))).select("w", "s0", "s1", F.col("m").alias("src")))
    extend = judged.filter(F.col("id").eqNullSafe(F.col("m"))).select("w", "a", "p", "s0", "s1")

    # the texts that may lose words or take them from others, each with its anchors to extend
    none = F.lit(None)
    todo = (agreed.select("w", none.cast("bigint").alias("a"), none.cast("int").alias("p"), "s0", "s1", F.lit(False).alias("extend"), "src")
            .unionByName(extend.select("w", "a", "p", "s0", "s1", F.lit(True).alias("extend"), none.cast(kind).alias("src"))))
    by_text = todo.groupBy("w").agg(F.collect_list(F.struct("a", "p", "s0", "s1", "extend", "src")).alias("hits"))     # of one text
    needed = by_text.join(texts.select("w", "digest", F.col("low").alias("_low")), "w")
    # the row that stands for a text is found by text and identifier, so that copies spread
    needed = needed.withColumn("key", F.xxhash64("digest", F.col("_low").isNull(), "_low"))
    bodies = src.mapInArrow(_digested, f"id {kind}, text string, digest binary")
    work = (bodies.withColumn("key", F.xxhash64("digest", F.col("id").isNull(), "id")).select("digest", "key", "text").join(needed, ["digest", "key"])
            .groupBy("digest", "key").agg(F.first("w").alias("w"), F.first("_low").alias("id"), F.first("text").alias("text"), F.first("hits").alias("hits")))
    work = staged(work.drop("key"), "substring-work")

    windows = staged(work.select("id", "w", "text", "hits").mapInArrow(partial(_extended, length, seed), f"w bigint, id {kind}, a bigint, o int, x bigint, s int"), "substring-extended")
    met = (windows.groupBy("a", "o", "x").agg(F.min("id").alias("m"), F.max("id").alias("h"), nulls.alias("z"), F.count(F.lit(1)).alias("k"))
           .filter(_repeated(F.col("m"), F.col("h"), F.col("z"))))
    met = staged(met.select("a", "o", "x", "m", "k"), "substring-met")
    found = _looked_up(windows, met, ["a", "o", "x"], max(1, windows.count()), ["w", "s"]).filter(_later(F.col("id"), F.col("m")))
    extended = found.groupBy("w").agg(F.collect_list(F.struct(F.col("s").alias("s0"), F.col("s").alias("s1"), F.col("m").alias("src"))).alias("more"))     # of one text
    direct = F.transform(F.filter("hits", lambda t: ~t["extend"]), lambda t: F.struct(t["s0"].alias("s0"), t["s1"].alias("s1"), t["src"].alias("src")))
    spans = F.concat(direct, F.coalesce("more", F.array().cast(f"array<struct<s0:int,s1:int,src:{kind}>>")))
    cut = (work.join(extended, "w", "left").select("digest", "text", spans.alias("spans")).filter(F.size("spans") > 0)
           .mapInArrow(partial(_cut, length), f"digest binary, n_removed bigint, kept string, repeats array<struct<start:bigint,end:bigint,src:{kind}>>"))
    cut = staged(cut, "substring-cut")

    lookup = staged(texts.select("digest", "low", "rows").join(
        cut.select("digest", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"), "kept", "repeats"), "digest", "left"), "substring-lookup")
    rows = marks.select("id", "digest", "n")
    out = hot_aware_lookup(rows, lookup, ["digest"], "rows", max(1, marks.count()))
    copy = _later(F.col("id"), F.col("low")) & (F.col("n") >= length)
    own = F.col("id").eqNullSafe(F.col("low"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(own, F.col("kept")).alias("kept"), F.when(own, F.col("repeats")).alias("repeats"))
