"""Change-risk analytics and training-data operators as PySpark DataFrame code."""
