"""Termforge: text retrieval, ranking and language identification as PySpark DataFrame plans."""
