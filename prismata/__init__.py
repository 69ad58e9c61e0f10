"""Spark-first analytics over code repositories and the questions asked about them."""
