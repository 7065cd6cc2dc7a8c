"""The jobs on streams."""
