"""Registered queries and their oracles, by area."""
