"""Readers and writers of documents, API descriptions, packages and snapshots."""
