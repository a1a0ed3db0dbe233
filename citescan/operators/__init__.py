"""Operators from documents to decided citations, and their evaluation."""
