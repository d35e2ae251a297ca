"""Tessera: document and code-knowledge analytics expressed as PySpark DataFrame plans."""
