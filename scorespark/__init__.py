"""Score histories and at-risk feature tables as Spark jobs."""
