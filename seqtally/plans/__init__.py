"""Composed queries and the registry the driver entry reads."""
