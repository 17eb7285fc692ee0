"""All registered queries; importing a module registers its queries."""

from catalog.core import ORACLE, QUERIES
from catalog import (  # noqa: F401
    q_assign, q_columns, q_datasets, q_lines, q_pipelines, q_scoring, q_sequence, q_streaming, q_teams,
)

__all__ = ["QUERIES", "ORACLE"]
