"""Text-quality analytics on Spark: features of texts as DataFrame expressions, feature tables, models and rollups."""
