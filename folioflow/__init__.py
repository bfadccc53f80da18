"""folioflow: DataFrame operators for document, review and ranking data on Spark."""

__version__ = "0.1.0"
