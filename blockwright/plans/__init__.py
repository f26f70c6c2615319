"""Placement of blocks and session helpers."""
