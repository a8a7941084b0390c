"""Station and grid analytics as lazy DataFrame operators on Spark."""
