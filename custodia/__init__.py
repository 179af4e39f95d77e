"""custodia: responsibility analytics over version-control history and source trees, on Spark."""

__version__ = "0.1.0"
