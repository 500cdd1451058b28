"""A PySpark engine for research on candle tables."""
