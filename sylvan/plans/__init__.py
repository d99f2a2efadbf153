"""Registered queries and their SQL, by area."""
