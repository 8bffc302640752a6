"""Column-level functions: native expressions, no UDFs."""
