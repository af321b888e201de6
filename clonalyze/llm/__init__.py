"""Operators of a training-data pipeline (dedup, language, safety, mixing, tokens, archives, search)."""
