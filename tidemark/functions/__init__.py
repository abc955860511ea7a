"""Column-level functions and models."""
