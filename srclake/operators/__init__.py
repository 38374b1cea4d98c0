"""Relational, graph, metric, navigation, search and history operators; each takes DataFrames and column names."""
