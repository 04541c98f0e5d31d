"""Search, ranking and analysis of document collections as PySpark jobs."""
