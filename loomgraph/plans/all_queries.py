"""Imports the modules that register queries."""

from loomgraph.plans import analyze, graph, names, relational, streams  # noqa: F401
