"""Readers: bytes or text columns to blocks, cells, records, cues and contacts."""
