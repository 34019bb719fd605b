"""Set-based text retrieval and corpus analytics on PySpark DataFrames."""
