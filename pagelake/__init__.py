"""pagelake: page-level document corpora as Spark DataFrame jobs."""
