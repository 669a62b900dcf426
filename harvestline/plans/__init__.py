"""Plans of the harvestline package."""
