"""Retrieval, evaluation and corpus operators expressed as Spark plans."""
