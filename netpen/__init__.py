"""netpen: cage-farm analytics as Spark DataFrame jobs."""
