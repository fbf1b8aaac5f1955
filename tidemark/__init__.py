"""Tidemark: business-analytics operators written as PySpark DataFrame programs."""
