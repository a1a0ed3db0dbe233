"""Column functions and word lists of the legal domain."""
