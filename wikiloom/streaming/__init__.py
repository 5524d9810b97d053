"""Change feeds of page revisions."""
