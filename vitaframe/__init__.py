"""Personal-sensor analytics as PySpark DataFrame transformations."""
