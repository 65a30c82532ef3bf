"""Sources of tamis."""
