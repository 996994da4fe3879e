"""Readers with stated schemas, and the idempotent sink."""
