"""Spark-first engine for web evidence: results, pages, passages, citations and their clean-up."""
