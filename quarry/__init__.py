"""quarry: page text to traceable, evaluable retrieval corpora, on Spark."""

__version__ = "0.1.0"
