"""quarry: documentation and API-reference queries as Spark DataFrame plans."""

__version__ = "0.1.0"
