"""Column expressions: no actions, no shuffles."""
