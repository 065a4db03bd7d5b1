"""Names, limits and rules of the fact model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
NODE_KINDS = ("repository", "project", "package", "file", "namespace", "type", "interface", "callable", "property", "field", "parameter", "export")
EDGE_KINDS = ("contains", "declares", "references", "calls", "invokes-name", "implements", "inherits", "imports", "resolves-to", "depends-on", "returns", "accepts", "exercised-by", "exports")
QUALITIES = ("Structural", "Resolved", "Derived", "Inferred")
RUN_STATUSES = ("Running", "Completed", "Failed", "Cancelled")
CONTAINMENT = ("contains", "declares")
IMPACT = ("references", "calls", "implements", "inherits", "depends-on")
BATCH_NODES, BATCH_DECLARATIONS, BATCH_EDGES = 2_000, 2_000, 5_000
MAX_PROPERTIES, MAX_TEXT, MAX_LIST, MAX_ERRORS = 64, 32_768, 1_024, 100
UNIT_BATCHES, UNIT_FACTS = 1_024, 1_000_000
SOURCE_BYTES, TOTAL_BYTES = 16 << 20, 512 << 20
PATTERN_LIMIT, PATTERN_LIMIT_MAX, BATCH_NAMES, BATCH_SEEDS = 50, 200, 100, 32


def valid_identifier(c: Column) -> Column:
    """Not blank, no white space at its ends, no control characters."""
    return c.isNotNull() & (F.length(F.trim(c)) > 0) & ~c.rlike(r"^\s|\s$") & ~c.rlike(r"\p{Cc}")


def valid_path(c: Column) -> Column:
    """A relative path without parent segments (after backslashes became slashes)."""
    p = F.translate(c, "\\", "/")
    return c.isNotNull() & (p != "") & ~p.rlike(r"^/|^[A-Za-z]:") & ~p.rlike(r"(^|/)\.\.(/|$)")


def valid_location(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """1-based and not ending before its start."""
    return (start_line >= 1) & (start_col >= 1) & (F.struct(end_line.alias("l"), end_col.alias("c")) >= F.struct(start_line.alias("l"), start_col.alias("c")))


def valid_evidence(quality: Column, confidence: Column) -> Column:
    """A known quality; a confidence between 0 and 1 with inferred evidence only."""
    return quality.isin(*QUALITIES) & (confidence.isNull() | ((quality == "Inferred") & confidence.between(0.0, 1.0)))


def deterministic(quality: Column) -> Column:
    """Evidence that is not inferred."""
    return quality.isin(*QUALITIES[:3])
