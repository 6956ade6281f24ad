"""tallyloom.plans."""
