"""Relational operators of equity-factor research: pure functions of DataFrames."""
