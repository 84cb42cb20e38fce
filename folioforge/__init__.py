"""folioforge: a PySpark-native analytics engine for document and bibliographic corpora."""
__version__ = "0.1.0"
