"""lakeglean: retrieval and knowledge-corpus analytics as Spark DataFrame plans."""
