"""Data-cube analytics expressed as Spark DataFrame plans."""
