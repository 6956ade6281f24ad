"""tallyloom.streaming."""
