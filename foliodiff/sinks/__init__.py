"""Reports as files."""
