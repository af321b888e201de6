"""Registered queries: corpus build, splits, token labels, tokenisation, masked-LM shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonalyze.functions.regions import full_vdj, gene_family
from clonalyze.functions.residues import ALPHABET, binary_class, encode_labels, mask_render, pad_labels, tokenize
from clonalyze.operators import corpus as CO
from clonalyze.operators.filters import oas_quality
from clonalyze.plans.catalog import sqlkit as K
from clonalyze.plans.catalog.views_sql import with_views as W
from clonalyze.sources import fixtures as fx
from clonalyze.sources.tables import table

ENTRIES: dict = {}


def reg(name, sql=None, views=("contigs",), extra=""):
    def deco(fn):
        ENTRIES[name] = (fn, W(sql, *views, extra=extra) if sql is not None else None)
        return fn
    return deco


def _u(*parts: str) -> str:
    """DuckDB twin of unit_hash."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def _ints(col: str) -> str:
    return f"array_to_string({col}, ' ')"


def _join_ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


OAS_WHERE = """length(coalesce(fwr1, '')) >= 20 AND length(coalesce(fwr4, '')) >= 10 AND length(coalesce(cdr1, '')) BETWEEN 5 AND 12
  AND length(coalesce(cdr2, '')) BETWEEN 1 AND 10 AND length(coalesce(cdr3, '')) BETWEEN 5 AND 38"""


@reg("J15_G3_corpus_split", f"""SELECT seq_id, sequence_alignment_aa, CASE WHEN {_u("''", 'CAST(seq_id AS VARCHAR)')} < 0.8 THEN 'train'
  WHEN {_u("''", 'CAST(seq_id AS VARCHAR)')} < 0.9 THEN 'val' ELSE 'test' END AS split
FROM (SELECT seq_id, {K.FULL} AS sequence_alignment_aa FROM contigs WHERE {OAS_WHERE}) o WHERE sequence_alignment_aa IS NOT NULL""")
def j15(spark, sf):
    c = oas_quality(fx.contigs(spark, sf)).select("seq_id", full_vdj().alias("sequence_alignment_aa"))
    return CO.build_corpus(c).select("seq_id", "sequence_alignment_aa", "split")


@reg("G4_nested_split", f"""SELECT id, CASE WHEN {_u("'seed42'", 'CAST(id AS VARCHAR)')} < 0.1 THEN 'eval'
  WHEN {_u("'seed42/2'", 'CAST(id AS VARCHAR)')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM scored_multi""", ("scored_multi",))
def g4(spark, sf):
    return CO.nested_split(fx.scored_multi(spark, sf), "id", 0.1, 0.2, salt="seed42").select("id", "split")


@reg("G4_stratified_split", """WITH f AS (SELECT seq_id, split_part(v_gene, '-', 1) AS v_family FROM contigs),
r AS (SELECT seq_id, v_family, count(*) OVER (PARTITION BY v_family) AS n,
  row_number() OVER (PARTITION BY v_family ORDER BY substr(md5(concat_ws(':', 'strata', CAST(seq_id AS VARCHAR))), 1, 15)) AS r FROM f)
SELECT seq_id, v_family, CASE WHEN r <= floor(n * 0.15 + 0.5) THEN 'eval' ELSE 'train' END AS split FROM r""", ("contigs",))
def g4_stratified(spark, sf):
    c = fx.contigs(spark, sf).select("seq_id", gene_family("v_gene").alias("v_family"))
    return CO.stratified_split(c, "v_family", "seq_id", 0.15, "strata").select("seq_id", "v_family", "split")


@reg("H13_H14_H16_label_arrays", """WITH t AS (SELECT seq_id, list(aa ORDER BY pos) AS residues, list(label ORDER BY pos) AS labels,
  list(CAST(round_even(prob, 0) AS INT) ORDER BY pos) AS preds FROM token_labels GROUP BY seq_id),
e AS (SELECT seq_id, residues, preds, list_transform(labels, lambda x: CASE WHEN x = 'P' THEN 1 ELSE 0 END) AS enc FROM t)
SELECT seq_id, CAST(len(enc) AS INT) AS n_labels,
  array_to_string(list_concat(list_concat([-100], list_slice(enc, 1, 148)), list_transform(range(greatest(149 - len(list_slice(enc, 1, 148)), 0)), lambda x: -100)), ' ') AS padded,
  array_to_string(list_transform(list_zip(residues, preds), lambda z: CASE WHEN z[2] = 1 THEN z[1] ELSE '-' END), '') AS rendered
FROM e""", ("token_labels",))
def h13(spark, sf):
    t = fx.token_labels(spark, sf, together=True).withColumn("pred", binary_class("prob"))
    g = t.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "aa", "label", "pred"))).alias("_t"))
    g = g.select("seq_id", F.transform("_t", lambda x: x["aa"]).alias("residues"), F.transform("_t", lambda x: x["label"]).alias("labels"),
                 F.transform("_t", lambda x: x["pred"]).alias("preds"))
    enc = encode_labels("labels")
    return g.select("seq_id", F.size(enc).cast("int").alias("n_labels"), _join_ints(pad_labels(enc, 150)).alias("padded"),
                    mask_render("residues", "preds").alias("rendered"))


def _tok_sql(seq: str, max_len: int) -> str:
    ids = f"list_transform(string_split({seq}, ''), lambda c: CASE WHEN strpos('{ALPHABET}', c) > 0 THEN strpos('{ALPHABET}', c) + 4 ELSE 3 END)"
    full = f"list_concat(list_concat([0], list_slice({ids}, 1, {max_len - 2})), [2])"
    return full


@reg("H15_tokenize_cdr3", f"""WITH f AS (SELECT seq_id, {_tok_sql('cdr3', 30)} AS fl FROM contigs WHERE cdr3 IS NOT NULL)
SELECT seq_id, array_to_string(list_concat(fl, list_transform(range(30 - len(fl)), lambda x: 1)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(fl, lambda x: 1), list_transform(range(30 - len(fl)), lambda x: 0)), ' ') AS attention_mask,
  array_to_string(list_concat(list_concat(list_concat([1], list_transform(range(len(fl) - 2), lambda x: 0)), [1]),
    list_transform(range(30 - len(fl)), lambda x: 1)), ' ') AS special_tokens_mask FROM f""")
def h15(spark, sf):
    c = fx.contigs(spark, sf).filter(F.col("cdr3").isNotNull()).select("seq_id", tokenize(F.col("cdr3"), 30).alias("t"))
    return c.select("seq_id", _join_ints("t.input_ids").alias("input_ids"), _join_ints("t.attention_mask").alias("attention_mask"),
                    _join_ints("t.special_tokens_mask").alias("special_tokens_mask"))


_RAW = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@reg("H15_tokenize_raw_letters", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_RAW}, '.{{1,148}}')) AS s,
  CAST(unnest(range(0, len(regexp_extract_all({_RAW}, '.{{1,148}}')))) AS INT) AS win FROM documents),
f AS (SELECT doc_id, win, {_tok_sql('s', 150)} AS fl FROM w)
SELECT doc_id, win, array_to_string(list_concat(fl, list_transform(range(150 - len(fl)), lambda x: 1)), ' ') AS input_ids,
  CAST(len(list_filter(fl, lambda x: x = 3)) AS INT) AS n_unknown FROM f""", ())
def h15_raw(spark, sf):
    """All letters of every document in windows of 148: letters that are no residue become the unknown token."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    docs = table(spark, sf, "documents").select("doc_id", letters.alias("s"))
    w = docs.select("doc_id", F.posexplode(F.regexp_extract_all("s", F.lit(".{1,148}"), F.lit(0))).alias("win", "s"))
    t = w.select("doc_id", "win", tokenize(F.col("s"), 150)["input_ids"].alias("ids"))
    return t.select("doc_id", F.col("win").cast("int").alias("win"), _join_ints("ids").alias("input_ids"),
                    F.size(F.filter("ids", lambda x: x == 3)).cast("int").alias("n_unknown"))


def _mlm_sql() -> str:
    h = "md5(concat_ws(':', CAST(seq_id AS VARCHAR), CAST(i - 1 AS VARCHAR)))"

    def hx(k: int) -> str:
        return f"(CAST(('0x' || substr({h}, {8 * k + 1}, 8)) AS BIGINT) / 4294967296.0)"

    sel = f"(x >= 5 AND {hx(0)} < 0.15)"
    masked = (f"list_transform(ids, lambda x, i: CASE WHEN NOT {sel} THEN x WHEN {hx(1)} < 0.8 THEN 4 "
              f"WHEN {hx(1)} < 0.9 THEN CAST(5 + floor({hx(2)} * 20) AS INT) ELSE x END)")
    labels = f"list_transform(ids, lambda x, i: CASE WHEN {sel} THEN x ELSE -100 END)"
    return f"""WITH f AS (SELECT seq_id, {_tok_sql('s', 150)} AS fl FROM (SELECT seq_id, {K.FULL} AS s FROM contigs WHERE chain = 'IGH') z WHERE s IS NOT NULL),
p AS (SELECT seq_id, list_concat(fl, list_transform(range(150 - len(fl)), lambda x: 1)) AS ids FROM f)
SELECT seq_id, array_to_string(ids, ' ') AS input_ids, array_to_string({masked}, ' ') AS masked_ids, array_to_string({labels}, ' ') AS mlm_labels FROM p"""


@reg("J16_training_shards", _mlm_sql())
def j16(spark, sf):
    c = fx.contigs(spark, sf).filter(F.col("chain") == "IGH").select("seq_id", full_vdj().alias("sequence"))
    t = CO.training_shards(c.filter(F.col("sequence").isNotNull()), "sequence", "seq_id", 150)
    return t.select("seq_id", _join_ints("input_ids").alias("input_ids"), _join_ints("masked_ids").alias("masked_ids"),
                    _join_ints("mlm_labels").alias("mlm_labels"))


@reg("A13_sample_manifest", """SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS r FROM pages) x
WHERE (r - 1) % 10 = 0""", ())
def a13(spark, sf):
    return CO.sample_manifest(table(spark, sf, "pages").select("page_id", "url"), 10, "page_id")
