"""quarry: text and vector analytics over PySpark DataFrames."""
