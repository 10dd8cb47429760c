"""millrace: DataFrame operators for retrieval training data and its evaluation, written for Spark clusters."""

__version__ = "0.1.0"
