"""Web-corpus retrieval analytics as Spark DataFrame operators."""
