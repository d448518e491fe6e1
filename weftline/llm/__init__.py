"""Training-data operators: each module is one operator, written as Spark jobs."""
