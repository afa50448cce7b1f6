"""Imports every module of registered queries."""

from strataloom.plans import distribution_queries, extended_queries, graph_more_queries, graph_queries, history_queries, mining_queries, phrase_queries, repository_queries, source_queries, text_queries  # noqa: F401
