"""Streaming maintenance of tile archives."""
