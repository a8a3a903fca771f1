"""Spark-native engine for example sets, model outputs and their scores."""

__all__ = ["__version__"]
__version__ = "0.1.0"
