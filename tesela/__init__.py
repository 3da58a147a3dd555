"""tesela: text-retrieval analytics as Spark DataFrame plans."""
