"""quarrylight: evidence retrieval over large document tables, as Spark jobs."""
