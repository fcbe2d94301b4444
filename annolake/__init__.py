"""Analytics and training-data preparation for annotation datasets on PySpark."""

__version__ = "2.0.0"
