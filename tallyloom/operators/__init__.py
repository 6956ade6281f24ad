"""tallyloom.operators."""
