"""Registered query plans over the driver's tables, their SQL oracles and plan checks."""
