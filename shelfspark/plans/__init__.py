"""Session, table access and lineage cutting."""
from .session import build_session, cut, discard, read_table

__all__ = ["build_session", "cut", "discard", "read_table"]
