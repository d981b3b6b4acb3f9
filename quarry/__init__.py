"""Document retrieval and question answering as Spark DataFrame plans."""
