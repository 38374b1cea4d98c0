"""Code-analytics operators on PySpark DataFrames."""
