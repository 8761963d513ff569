"""Importing this module fills the query registry."""

from importlib import import_module

from .registry import QUERIES

for _name in (
    "source_queries", "row_queries", "join_queries", "aggregate_queries", "window_queries", "series_queries",
    "clinical_queries", "note_queries", "corpus_queries", "sampling_queries", "pair_queries", "model_queries",
    "metric_queries", "audit_queries", "stream_queries",
):
    import_module(f"{__package__}.{_name}")

__all__ = ["QUERIES"]
