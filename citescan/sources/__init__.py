"""Readers and writers of documents, annotations and results."""
