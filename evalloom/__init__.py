"""Evaluation-data and corpus-preparation jobs as Spark DataFrame transformations."""
