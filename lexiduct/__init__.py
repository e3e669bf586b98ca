"""lexiduct: search-as-you-type corpora and their traffic on Spark."""

__version__ = "0.1.0"
