"""Millrace: a retrieval and analytics engine on PySpark DataFrames."""
