"""Column expressions: entropy, addresses, widths of time."""
