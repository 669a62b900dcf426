"""Streaming of the harvestline package."""
