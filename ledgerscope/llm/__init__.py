"""Operators of a training-data pipeline: deduplication, filters, scoring,
token counts, mixing and packing.  Nothing else in the library imports this
package; queries are in ``queries.py``."""
