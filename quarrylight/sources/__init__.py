"""Readers that bring external records into the engine's schemas, and writers."""
