"""Document field extraction over a corpus, written as Spark DataFrame jobs."""
