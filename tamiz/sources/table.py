"""The contract every source returns: a lazy DataFrame and where it is from."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class SourceTable:
    """A table from any source. ``df`` stays lazy; ``order_by`` names columns
    that fix the row order, or is None for the order of the files."""

    df: DataFrame
    source: str
    path_or_table: str
    metadata: dict[str, Any] = field(default_factory=dict)
    order_by: list[str] | None = None

    def __repr__(self) -> str:
        return (
            f"SourceTable(source={self.source!r}, path_or_table={self.path_or_table!r}, "
            f"columns={len(self.df.columns)})"
        )


def reads_query(table: str | None, query: str | None) -> bool:
    """Whether a read is by query; it must name a table or a query, not both."""
    if (table is None) is (query is None):
        raise ValueError("name a table or a query")
    return query is not None
