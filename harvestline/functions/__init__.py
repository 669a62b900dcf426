"""Functions of the harvestline package."""
