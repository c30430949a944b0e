"""Public-transport demand and trip analytics as Spark DataFrame jobs."""
