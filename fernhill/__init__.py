"""Catalog retrieval and curation analytics as Spark DataFrame operators."""
