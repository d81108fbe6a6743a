"""Sources: files to tables."""
