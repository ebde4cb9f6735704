"""Table providers and file readers and writers."""
