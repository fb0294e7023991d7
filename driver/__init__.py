"""Queries over the driver tables and the SQL they are compared with."""
