"""Column functions: no UDFs."""
