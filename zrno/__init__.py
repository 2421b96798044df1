"""zrno: text-corpus analytics on PySpark DataFrames."""
