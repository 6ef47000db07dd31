"""Operators over DataFrames: ledger, graph, recall, fusion, statistics."""
