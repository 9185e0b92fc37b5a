"""Types, literals and small column functions."""
