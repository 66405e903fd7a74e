"""Lodestar: retrieval, graph, lifecycle and event analytics over labelled texts, as Spark jobs."""
