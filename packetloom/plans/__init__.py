"""Whole runs: the feature pipeline, training, detection and the report."""
