"""Registered queries: each applies operators of this library to the driver's tables."""
