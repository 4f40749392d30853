"""Checks and repairs that need no state, on streaming tables."""
