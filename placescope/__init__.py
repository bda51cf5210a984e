"""Area affluence analytics as Spark DataFrame jobs."""
