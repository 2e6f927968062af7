"""textloom: build, curate and report on text corpora as Spark DataFrame jobs."""
