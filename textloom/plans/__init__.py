"""Plans of the chunking and enrichment engine: every operator as a registered query with its DuckDB equivalent."""

from textloom.plans import catalog, chunking, enrichment  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES  # noqa: F401
