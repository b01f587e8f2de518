"""brindle: batch and streaming analytics as PySpark DataFrame plans."""
