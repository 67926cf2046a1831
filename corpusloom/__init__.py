"""corpusloom: document-corpus analytics written as Spark DataFrame jobs."""
