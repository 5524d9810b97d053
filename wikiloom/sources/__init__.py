"""Readers and writers of page dumps and saved corpora."""
