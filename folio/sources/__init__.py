"""Readers, writers and the driver-table views every query starts from."""
