"""Inference rules, joins, closures, pattern queries and counts over a knowledge base."""
