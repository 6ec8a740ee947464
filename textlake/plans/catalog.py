"""Imports every query module so that the registry is complete."""

from textlake.plans import queries_trend, queries_text, queries_vocab, queries_vectors, queries_eval, queries_models, queries_stream, queries_sources, queries_extra, queries_more  # noqa: F401
