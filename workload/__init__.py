"""The driver tables bound to the activity model, and the registered checks."""
