"""relspark: semantic relatedness over concept taxonomies, as PySpark DataFrame jobs."""

__version__ = "0.1.0"
