"""Whole programs: building, materialising and querying a knowledge base."""
