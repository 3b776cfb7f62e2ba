"""Panel and pair (dyad) event analytics as PySpark DataFrame operators."""
