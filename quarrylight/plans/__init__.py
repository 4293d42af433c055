"""Multi-operator plans and the registry of named queries."""
