"""plainlens: text-simplification corpus analytics expressed as Spark DataFrame plans."""
