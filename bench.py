"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with the ``noop`` sink (no driver collection) after
one warm-up query; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_pll_by_isotype_family",
    "E1_pll_context_full_vdj",
    "J4_scores_all_modes",
    "J6_scores_wide",
    "J7_combine_repertoire_scores",
    "J9_substitution_ranks",
    "J10_velocity_lineage_edges",
    "J11_C8_velocity_to_germline",
    "E13_roc_curve",
    "E16_token_metrics",
    "E18_pool_onehot",
    "J16_training_shards",
    "E10_ari_by_sample",
    "E15_macro_roc",
    "J5_embed_modes",
    "J13_node_metadata",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from clonalyze.plans.catalog import entries
    from clonalyze.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    reg = entries()
    names = [n for n in HEADLINE if n in reg]
    # warm-up: JVM, Python workers, parquet footer cache
    reg[names[0]][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        spark.catalog.clearCache()   # every query pays for its own inputs
        t0 = time.time()
        reg[n][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
