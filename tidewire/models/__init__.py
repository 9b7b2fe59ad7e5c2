"""Operators that ask an external model; the client is injected and may be a stub."""
