"""A PySpark engine for equity-factor research and training-data preparation."""
