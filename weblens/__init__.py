"""weblens: web-traffic analytics as PySpark DataFrame operators."""
