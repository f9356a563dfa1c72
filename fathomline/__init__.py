"""Survey, catch and harvest-limit analytics as PySpark DataFrame operators."""
