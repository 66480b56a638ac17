"""Registered queries, their SQL, and physical-plan helpers."""
