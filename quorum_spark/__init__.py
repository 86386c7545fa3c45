"""Identity-resolution and presence analytics as Spark DataFrame plans."""
