"""Spark-first analytics for labelled text-and-image data sets."""

__version__ = "0.1.0"
