"""Readers of session logs and adapters of the shared tables."""
