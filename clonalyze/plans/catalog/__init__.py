"""Registry of runnable queries: name -> (callable(spark, sf_dir) -> DataFrame, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["scoring", "basic", "evolution", "metrics", "vectors", "corpus", "ml", "graph"]


def entries() -> dict:
    out: dict = {}
    for m in MODULES:
        mod = importlib.import_module(f"clonalyze.plans.catalog.{m}")
        for k, v in mod.ENTRIES.items():
            if k in out:
                raise ValueError(f"duplicate query name {k}")
            out[k] = v
    return out
