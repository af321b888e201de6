"""Registered queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.llm import ann, bpe, exact_dedup, lang_id, license_scan, mix, periodic, pii, prefix_trie, simhash, substring, toxicity, warc
from clonalyze.llm.common import broadcast_if_small, staged, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grades = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.score(docs, toxicity.fit(docs, grades)).select("doc_id", "severity", "p_toxic", "grade", "toxic")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.content_sort(docs, carry_text=False).select(
        "doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha256").alias("text_sha256"))


OP2_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, and the known licence sentences in it."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("fragments", ",").alias("fragments"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back from the archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_pages(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


# base32 has no function in DuckDB: the digest's 40 hex digits are read as 32 groups of 5 bits
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(substr(bits, 5 * i + 1, 5) AS BIT) AS INT), 1), '' ORDER BY i) AS digest
  FROM (SELECT h, list_aggregate(list_transform(range(1, 41), lambda x: right(CAST(CAST(strpos('0123456789abcdef', substr(h, CAST(x AS INT), 1)) - 1 AS INT)::BIT AS VARCHAR), 4)), 'string_agg', '') AS bits
        FROM (SELECT DISTINCT h FROM p)) x, range(32) r(i)
  GROUP BY h),
g AS (SELECT t, max(page_id) AS top FROM p WHERE page_id IS NOT NULL GROUP BY t)
SELECT p.page_id, CAST(octet_length(encode(p.t)) AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN p.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.top THEN g.top END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p JOIN b USING (h) LEFT JOIN g ON p.t = g.t
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    out = lang_id.held_out(F.col("doc_id"))
    models = lang_id.train(docs.filter(~out).select("doc_id", "text", "lang"))
    found = lang_id.predict(docs.select("doc_id", "text"), models)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                                F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (  -- sources by the level at which they reach their cap
  SELECT *, CAST(2 * source_size AS DOUBLE) / w AS full_at,
    sum(w) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    1.5 * sum(source_size) OVER () AS goal
  FROM s),
l AS (SELECT arg_min(CAST(goal - capped AS DOUBLE) / w_left, full_at) AS level FROM r WHERE CAST(goal - capped AS DOUBLE) / w_left <= full_at),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * level) AS target FROM s, l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN budget > 0 AND (upto <= budget
      OR (upto - own < budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs, shingle=3, tau=2)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 50-word window of an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS x
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50) t),
f AS (SELECT x, min(doc_id) AS m FROM w GROUP BY x),
c AS (SELECT rid, i, 1 AS hit FROM w JOIN f USING (x) WHERE w.doc_id > f.m OR (w.doc_id IS NULL AND f.m IS NOT NULL)),
e AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
g AS (
  SELECT e.rid, e.i, e.word, max(c.hit) OVER (PARTITION BY e.rid ORDER BY e.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM e LEFT JOIN c ON e.rid = c.rid AND e.i = c.i),
k AS (
  SELECT rid, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone IS NULL) AS kept
  FROM g GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""


HEAD = 8     # turns at most that a conversation takes from another


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of the contract's rebuilt conversations: a head of the first of five, then the own turns after it."""
    turns = staged(turns, "trie-numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    convs = staged(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base")), "trie-conversations")
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = staged(convs.join(sizes, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head")), "trie-heads")
    # at most nine conversations share a base, and each takes at most HEAD of its turns
    first = turns.filter(F.col("t") <= HEAD).withColumnRenamed("conv", "base")
    heads = convs.filter("head > 0").join(first, "base").filter("t <= h").select("conv", "t", "role", "text")
    tails = (turns.join(broadcast_if_small(convs.select("conv", "h", "head")), "conv").filter("t > h")
             .select("conv", (F.col("t") - F.col("h") + F.col("head")).alias("t"), "role", "text"))
    return heads.unionByName(tails), convs.select("conv")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(*_rebuilt(prefix_trie.numbered(table(spark, sf_dir, "conversations"))))


# CRC-32 has no function in DuckDB: eight steps of one bit for every byte
OP12_SQL = """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda a, x: list_reduce(range(0, 8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM o) x),
z AS (SELECT v.c, v.base, v.h, least(v.h, coalesce(n.n, 0)) AS head FROM v LEFT JOIN (SELECT c, count(*) AS n FROM o GROUP BY c) n ON n.c = v.base),
r AS (
  SELECT z.c, o.t, o.role, o.text FROM z JOIN o ON o.c = z.base AND o.t <= z.h
  UNION ALL SELECT z.c, o.t - z.h + z.head, o.role, o.text FROM z JOIN o ON o.c = z.c AND o.t > z.h),
p AS (SELECT c, t AS d, octet_length(encode(text)) AS bytes,
    md5(string_agg(md5(concat(length(role), ':', role, text)), ',') OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k FROM r
  UNION ALL SELECT c, 0, 0, '' FROM v),
g AS (SELECT d, k, min(c) AS m, count(*) AS n, max(bytes) AS bytes FROM p GROUP BY d, k),
u AS (SELECT g.*, q.k AS pk, q.m AS pm FROM g LEFT JOIN p ON p.c = g.m AND p.d = g.d - 1 LEFT JOIN g q ON q.d = p.d AND q.k = p.k),
f AS (SELECT d - 1 AS d, pk AS k, count(*) AS children FROM u WHERE d > 0 GROUP BY d - 1, pk),
w AS (SELECT u.*, coalesce(f.children, 0) AS children FROM u LEFT JOIN f ON f.d = u.d AND f.k = u.k),
s AS (
  SELECT p.d, p.k, sum(CASE WHEN w.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((w.n - 1) * w.bytes) AS saved
  FROM w JOIN p ON p.c = w.m AND p.d <= w.d GROUP BY p.d, p.k),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
e AS (SELECT p.d, p.k, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS sha FROM p JOIN l ON l.c = p.c AND l.d = p.d GROUP BY p.d, p.k)
SELECT w.m AS conv_id, CAST(w.d AS BIGINT) AS depth, w.pm AS parent_conv_id, w.n AS n_convs, CAST(w.children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM w JOIN s ON s.d = w.d AND s.k = w.k LEFT JOIN e ON e.d = w.d AND e.k = w.k
"""


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repeats: by the hash of the identifier, a tenth of the texts turn periodic from word a on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (3 + g % 8 + 1))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, the longest one, and digests of runs and collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs, edit=_planted)
    told = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.array_min(F.transform("_runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("b.less")
    return rows.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"),
                       F.floor(length * 1000 / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ENTRIES = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op3_license_scan": (op3_license_scan, None),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_language_id": (op5_language_id, None),
    "op6_mix_sources": (op6_mix_sources, OP6_SQL),
    "op7_nearest_neighbours": (op7_nearest_neighbours, None),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_personal_data": (op9_personal_data, None),
    "op10_simhash_near_dedup": (op10_simhash_near_dedup, None),
    "op11_substring_dedup": (op11_substring_dedup, OP11_SQL),
    "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
    "op13_periodic_runs": (op13_periodic_runs, None),
    "pipeline": (pipeline, None),
}
