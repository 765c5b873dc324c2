"""Data governance over tables and streams, as PySpark DataFrame operators."""
