"""Code-quality analytics over source trees, as Spark jobs."""
