"""Readers, column mapping, the driver-table adapter and sinks."""

from ledgerscope.sources.transactions import (
    read_transactions, clean_numeric, standardise_columns, map_generic_columns,
    detect_label_column, select_numeric_features, profile, CANONICAL_MAP)
from ledgerscope.sources.adapters import txn_from_events, TXN_SQL
from ledgerscope.sources.sinks import write_results, flagged
from ledgerscope.sources.synthetic import synthetic_transactions

__all__ = [
    "read_transactions", "clean_numeric", "standardise_columns", "map_generic_columns",
    "detect_label_column", "select_numeric_features", "profile", "CANONICAL_MAP",
    "txn_from_events", "TXN_SQL", "write_results", "flagged", "synthetic_transactions",
]
