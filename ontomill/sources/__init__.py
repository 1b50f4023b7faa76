"""Readers and writers: N-Triples, axioms, class expressions, scratch tables."""
