"""Chart data as DataFrames, and reports as text."""
