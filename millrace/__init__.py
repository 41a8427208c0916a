"""millrace: data preparation, profiling and feature work as lazy Spark plans."""

__version__ = "0.1.0"
