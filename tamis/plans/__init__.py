"""Plans of tamis."""
