"""codeloom: code-and-text intelligence as PySpark DataFrame operators."""
