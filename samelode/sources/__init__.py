"""Where files, extents and blocks come from."""
