"""Readers and writers for tables, text artifacts and JSON payloads."""
