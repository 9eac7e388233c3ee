"""Fields from tables, and checks of gridded input."""
