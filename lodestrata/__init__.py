"""lodestrata: corpus analytics, retrieval and graph operators as Spark plans."""

__version__ = "0.1.0"
