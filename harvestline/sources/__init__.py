"""Sources of the harvestline package."""
