"""Functions of tamis."""
