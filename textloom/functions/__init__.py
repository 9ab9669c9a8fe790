"""Functions of the chunking and enrichment engine."""
