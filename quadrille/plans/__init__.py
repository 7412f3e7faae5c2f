"""Registered queries, their SQL, and request front ends."""
