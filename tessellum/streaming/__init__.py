"""Streams. The reference has none; these are features of the platform over event tables."""
