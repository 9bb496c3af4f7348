"""Continuous comparison: landed snapshots against the last known state."""
