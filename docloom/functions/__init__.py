"""Column builders: text, similarity, JSON-path and id helpers."""
