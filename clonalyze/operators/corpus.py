"""Corpus and training-data preparation.

Splits and masking use md5 of the key, so they are stable under re-runs, do not
depend on partitioning, and need no global sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonalyze.functions.residues import ALPHABET, IGNORE, SPECIAL_TOKENS, tokenize
from clonalyze.operators.dedupe import rank_within
from clonalyze.operators.joins import null_safe_join
from clonalyze.session import cut_lineage

# Corpus split 15,000,000 / 1,875,000 / 1,875,000 of 18.75 M, i.e. 80/10/10.
CORPUS_SPLIT = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
# Masked-LM selection rate and the usual 80/10/10 replacement rule.
MLM_RATE, MLM_MASK, MLM_RANDOM = 0.15, 0.8, 0.1
HASH_SCALE = float(16 ** 8)


def unit_hash(*parts) -> Column:
    """Uniform [0, 1) from md5 of the parts joined by ':' (equal in any SQL engine)."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / HASH_SCALE


def hash_split(df: DataFrame, key: str, fractions=CORPUS_SPLIT, salt: str = "", out: str = "split") -> DataFrame:
    """Label every row by where md5(salt:key) falls among the cumulative fractions."""
    u = unit_hash(F.lit(salt), F.col(key))
    expr, acc = None, 0.0
    for i, (name, frac) in enumerate(fractions):
        acc += frac
        cond = u < acc if i < len(fractions) - 1 else F.lit(True)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(out, expr)


def nested_split(df: DataFrame, key: str, eval_size: float = 0.1, test_size: float = 0.2, salt: str = "") -> DataFrame:
    """Hold out ``eval_size`` first, then split the rest train / test by ``test_size``."""
    first = hash_split(df, key, [("eval", eval_size), ("rest", 1 - eval_size)], salt, "_s1")
    second = hash_split(first, key, [("test", test_size), ("train", 1 - test_size)], salt + "/2", "_s2")
    return second.withColumn("split", F.when(F.col("_s1") == "eval", "eval").otherwise(F.col("_s2"))).drop("_s1", "_s2")


SPLIT_BITS, LEVEL_BITS = 60, 12     # of the hash, and of it that one histogram tells apart


def stratified_split(df: DataFrame, cls: str, key: str, eval_size: float = 0.1, salt: str = "", out: str = "split") -> DataFrame:
    """G4 (stratified): of every class the share ``eval_size`` of its rows, to the nearest row, is 'eval', the rest 'train'.

    A class's eval rows are those of the smallest hashes of salt and key, so re-runs agree. The threshold is found without sorting: rows
    are counted by class and hash bucket (with map-side combine, at most 4,096 buckets a class), and only the bucket in which
    the running count reaches the share is refined by the next bits. Rows of one class and key share a hash and stay together; null is a class
    like any other.
    """
    def h(k: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(k).cast("string"))), 1, SPLIT_BITS // 4), 16, 10).cast("long")

    open_ = cut_lineage(df.select(F.col(cls).alias("_cls"), h(key).alias("_h")))
    want = cut_lineage(open_.groupBy("_cls").agg(F.floor(F.count(F.lit(1)) * F.lit(float(eval_size)) + 0.5).cast("long").alias("_want")))
    open_ = null_safe_join(open_, want.filter("_want > 0"), ["_cls"]).withColumn("_before", F.lit(0).cast("long"))
    for shift in range(SPLIT_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        hist = open_.groupBy("_cls", "_want", "_before", F.expr(f"shiftright(_h, {shift})").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        run = hist.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy("_cls").orderBy("_b")))
        edge = run.filter("_to >= _want").groupBy("_cls").agg(F.min(F.struct("_b", (F.col("_to") - F.col("_n")).alias("_start"), "_to", "_want")).alias("_e"))
        edge = cut_lineage(edge.select("_cls", "_e.*"))
        if shift:
            nxt = null_safe_join(open_.drop("_want", "_before"), edge.select("_cls", "_b", "_want", F.col("_start").alias("_before")), ["_cls"])
            open_ = cut_lineage(nxt.filter(F.expr(f"shiftright(_h, {shift})") == F.col("_b")).drop("_b"))
    # the hash at the edge counts if that brings the class nearer to its share
    at = F.when(F.col("_to") - F.col("_want") <= F.col("_want") - F.col("_start"), F.col("_b")).otherwise(F.col("_b") - 1)
    below = edge.select(F.col("_cls").alias(cls), at.alias("_below"))
    j = null_safe_join(df, below, [cls], "left")
    return j.select(*[c for c in df.columns if c != out], F.when(h(key) <= F.col("_below"), "eval").otherwise("train").alias(out))


def label_arrays(tokens: DataFrame, keys: Sequence[str] = ("seq_id",), pos: str = "pos", label: str = "label",
                 aa: str = "aa") -> DataFrame:
    """Per-sequence residue and label arrays in position order (one sequence's
    residues: bounded by the sequence length)."""
    keys = list(keys)
    g = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, aa, label))).alias("_t"))
    return g.select(*keys, F.transform("_t", lambda t: t[aa]).alias("residues"), F.transform("_t", lambda t: t[label]).alias("labels"))


def _hex_unit(h: Column, k: int) -> Column:
    """Uniform [0, 1) from the k-th group of 8 hex digits of an md5 string."""
    return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") / HASH_SCALE


def _hex_below(hex8: Column, share: float) -> Column:
    """Whether the unit number that a hex string's first 8 digits stand for is below ``share``: digits are compared as text."""
    first_out = math.ceil(share * HASH_SCALE)
    return hex8.isNotNull() if first_out >= HASH_SCALE else hex8 < F.lit(f"{max(first_out, 0):08x}")


def token_hashes(input_ids: Column, key: Column) -> Column:
    """md5(key:i) for every token position i that holds no special token (null there); ``key`` as text with its colon."""
    return F.transform(input_ids, lambda x, i: F.when(x >= len(SPECIAL_TOKENS), F.md5(F.concat(key, i.cast("string")))))


def hash_key(key: Column) -> Column:
    """What stands before the position in a token's hash (a null key: nothing)."""
    return F.coalesce(F.concat(key.cast("string"), F.lit(":")), F.lit(""))


def masked_lm(input_ids: Column, key: Column, rate: float = MLM_RATE, hashes: Column | None = None) -> Column:
    """(masked_ids, mlm_labels). Token i of a row hashes md5(key:i) once;
    its first 8 hex digits select non-special tokens (< rate), the next 8 choose
    the replacement (<mask> 80 %, random residue 10 %, unchanged 10 %) and the
    next 8 the random residue. Labels hold the original id where selected, -100
    elsewhere."""
    n_special = len(SPECIAL_TOKENS)
    hashes = token_hashes(input_ids, hash_key(key)) if hashes is None else hashes

    def replace(x, h):
        r = F.substring(h, 9, 8)
        rnd = F.lit(n_special) + (_hex_unit(h, 2) * len(ALPHABET)).cast("int")
        chosen = F.when(_hex_below(r, MLM_MASK), F.lit(SPECIAL_TOKENS["<mask>"])).when(_hex_below(r, MLM_MASK + MLM_RANDOM), rnd).otherwise(x)
        return F.when(_hex_below(h, rate), chosen).otherwise(x)

    masked = F.zip_with(input_ids, hashes, replace)
    labels = F.zip_with(input_ids, hashes, lambda x, h: F.when(_hex_below(h, rate), x).otherwise(F.lit(IGNORE)))
    return F.struct(masked.alias("masked_ids"), labels.alias("mlm_labels"))


def training_shards(corpus: DataFrame, seq: str = "sequence", key: str = "seq_id", max_len: int = 150,
                    rate: float = MLM_RATE) -> DataFrame:
    """Tokenised, padded sequences with attention / special masks and masked-LM inputs."""
    t = corpus.select(key, tokenize(F.col(seq), max_len).alias("_t"))
    t = t.select(key, "_t.*", hash_key(F.col(key)).alias("_k"))
    # hashes projected once as a column; both output arrays read it
    t = t.withColumn("_h", token_hashes(F.col("input_ids"), F.col("_k")))
    return t.withColumn("_m", masked_lm(F.col("input_ids"), F.col(key), rate, F.col("_h"))).select(
        key, "input_ids", "attention_mask", "special_tokens_mask", "_m.masked_ids", "_m.mlm_labels")


def sample_manifest(df: DataFrame, n: int, order: str) -> DataFrame:
    """Every n-th entry (1st, n+1-th, ...) of a manifest by ``order``."""
    r = rank_within(df, [], [order])
    return r.filter((F.col("_rank") - 1) % n == 0).drop("_rank")


def build_corpus(oas: DataFrame, seq: str = "sequence_alignment_aa", key: str = "seq_id", fractions=CORPUS_SPLIT) -> DataFrame:
    """Quality-filtered sequences (B5 applied by the caller) labelled train / val / test."""
    return hash_split(oas.select(key, seq).filter(F.col(seq).isNotNull()), key, fractions)


def write_corpus(df: DataFrame, path: str, seq: str = "sequence_alignment_aa", split: str = "split") -> None:
    """J15 sink: one sequence per line, one folder per split (``split=train`` ...)."""
    df.select(split, F.col(seq).alias("value")).write.mode("overwrite").partitionBy(split).text(path)
