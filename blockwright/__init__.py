"""Replicated, addressable block data and iterative analytics as Spark plans."""
