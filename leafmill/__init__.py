"""leafmill: a PySpark-native engine for book-like documents and the text tables made from them."""

__version__ = "0.1.0"
