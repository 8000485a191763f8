"""Panel time-series analytics on Spark: bars, features, evaluation, portfolios, screens."""

__version__ = "0.1.0"
