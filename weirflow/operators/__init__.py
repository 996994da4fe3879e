"""Operators over static tables: replay forms whose clock is the data's own time."""
