"""Byte-level container operators and their DataFrame forms."""
