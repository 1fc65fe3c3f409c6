"""Point-in-time equity screening and research as Spark jobs."""
