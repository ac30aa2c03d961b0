"""Column functions: symbols, dates, names and cross-sectional statistics."""
