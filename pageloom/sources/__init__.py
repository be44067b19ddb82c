"""Readers and the adapters that turn flat tables into positioned blocks."""
