"""Relational building blocks: filters, joins, clusters, scores, history, metrics."""
