"""Column functions: naming, text, routing and keys."""
