"""limpid: text and URL hygiene at scale, as plain PySpark DataFrame operators."""

__version__ = "0.1.0"
