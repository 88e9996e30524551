"""Readers, the driver-table adapter and writers."""

from stocklens.sources.tables import (
    RAW_SCHEMAS, check_columns, empty_like, list_clients, read_optional, read_tables,
    scope_details, tpch_retail_tables,
)

__all__ = [
    "RAW_SCHEMAS", "check_columns", "empty_like", "list_clients", "read_optional",
    "read_tables", "scope_details", "tpch_retail_tables",
]
