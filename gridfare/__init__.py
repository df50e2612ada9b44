"""Grid-annotation and fare-observation analytics as PySpark DataFrame operators."""
