"""Relational operators over blocks, cells, cues, items and records."""
