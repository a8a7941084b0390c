"""Training-data operators on Spark.  Nothing outside this folder imports it."""
