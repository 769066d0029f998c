"""Readers with explicit schemas and the result-table sink."""

from tabscope.sources.files import (
    read_csv,
    read_documents,
    read_named_columns,
    read_pipe,
    read_tsv,
    write_table,
)

__all__ = ["read_csv", "read_documents", "read_named_columns", "read_pipe", "read_tsv", "write_table"]
