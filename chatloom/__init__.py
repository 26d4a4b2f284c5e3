"""chatloom: chat-memory analytics as Spark DataFrame jobs."""
