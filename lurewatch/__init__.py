"""Mail threat analysis over whole corpora, as Spark table jobs."""

__version__ = "0.1.0"
