"""Whole plans: the citation pipeline and the registered queries."""
