"""Sequences that grow by micro-batches."""

from .append import appender, read_sequence

__all__ = ["appender", "read_sequence"]
