"""Document and catalogue analytics as PySpark DataFrame operators."""
