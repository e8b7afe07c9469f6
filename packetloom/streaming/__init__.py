"""The same computations over unbounded input."""
