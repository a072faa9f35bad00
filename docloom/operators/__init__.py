"""Relational, retrieval and document operators as DataFrame functions."""
