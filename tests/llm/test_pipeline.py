import hashlib
import random

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import tiktoken

from clonalyze.llm import bpe
from tests.llm.test_exact_dedup import brute as brute_copies
from tests.llm.test_mix import brute as brute_mix
from tests.llm.test_simhash import brute_rows


def write(spark, folder):
    rnd = random.Random(9)
    docs, labels = [], []
    vocabulary = [f"wo{i}rd" for i in range(400)]
    for i in range(240):
        words = rnd.choices(vocabulary, k=rnd.randrange(30, 120))
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = ["vile", "scum"]
        docs.append((i, " ".join(words), "en", f"src{i % 5 if i % 3 else 0}", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    for i in range(240, 300):       # exact and near copies of clean documents
        text = docs[1 + 6 * (i % 20)][1]
        docs.append((i, text.replace(" ", "\n", 3) if i % 2 else text.replace(" ", " extra ", 1), "en", "src1", 0))
    docs += [(300, None, None, None, None), (301, "", "en", "src2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path / "sf")
    docs = write(spark, folder)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = C.table(spark, folder, "documents")
    kept = [tuple(r) for r in C.drop_toxic(spark, frame, folder).collect()]
    assert {r[0] for r in kept} == {i for i, t, *_ in docs if "vile" not in (t or "")}

    for stage, expect in [
        (C.drop_copies, lambda rows: {x[0] for x in brute_copies([(r[0], r[1]) for r in rows]) if x[3]}),
        (C.drop_near_copies, lambda rows: {x[0] for x in brute_rows([(r[0], r[1]) for r in rows], C.SHINGLE, C.MAX_BITS) if x[0] == x[2]}),
    ]:
        df = stage(spark, spark.createDataFrame(kept, frame.schema), folder)
        assert df.columns == columns
        out = [tuple(r) for r in df.collect()]
        assert {r[0] for r in out} == expect(kept) and len(out) == len({r[0] for r in out}) and set(out) <= set(kept)
        kept = out

    df = C.mix_sources(spark, spark.createDataFrame(kept, frame.schema), folder)
    assert df.columns == columns
    mixed = [tuple(r) for r in df.collect()]
    size = {x[0]: (x[1], x[4]) for x in brute_mix([(r[0], r[3], r[1]) for r in kept])}
    for i, (n, taken) in size.items():
        if n:
            assert sum(r[0] == i for r in mixed) * n == taken
    final = [tuple(r) for r in C.tokenise(spark, spark.createDataFrame(mixed, frame.schema), folder).select(
        "doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(P.path(C.VOCABULARY))), special_tokens={})
    want = []
    for r in mixed:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], r[3], len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(final, key=repr) == sorted(want, key=repr)
    run = [tuple(r) for r in C.run(spark, folder).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(run, key=repr) == sorted(want, key=repr)


def test_contract():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    assert C.ORACLE_SQL is None
