"""FIX message analytics on Spark, and operators for large text corpora."""
