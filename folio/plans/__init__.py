"""Jobs a user calls: compositions of operators ending in page-level tables."""
