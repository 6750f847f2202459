"""ragloom: retrieval and conversation analytics as Spark jobs."""
