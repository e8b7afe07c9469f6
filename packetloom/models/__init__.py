"""Unsupervised models: fitted and applied as Spark jobs, kept as small tables."""
