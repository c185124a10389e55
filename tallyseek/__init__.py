"""Text retrieval and retail demand forecasting as Spark DataFrame transformations."""

__version__ = "0.1.0"
