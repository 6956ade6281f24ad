"""tallyloom.functions."""
