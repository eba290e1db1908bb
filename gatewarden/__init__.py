"""Security analytics over web access logs, and data preparation operators, as Spark jobs."""
