"""Document chunking, enrichment and catalog jobs as Spark DataFrame operators."""
