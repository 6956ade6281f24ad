"""tallyloom.sources."""
