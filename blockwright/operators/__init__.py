"""Operators over blocks, ranks and measurements."""
