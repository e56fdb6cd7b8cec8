"""Card-transaction analytics on Spark: import, training and streaming inference."""
