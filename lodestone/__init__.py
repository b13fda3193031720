"""Evidence, retrieval and context assembly as Spark queries."""
