"""corpusloom: file corpora and declared task graphs as Spark tables and streams."""
