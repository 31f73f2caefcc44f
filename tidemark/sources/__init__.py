"""Reading and writing tables."""

from .tables import read_table, write_table

__all__ = ["read_table", "write_table"]
