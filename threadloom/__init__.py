"""Graph-structured evidence retrieval and its evaluation as Spark plans."""
