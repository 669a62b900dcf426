"""Operators of the harvestline package."""
