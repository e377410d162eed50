"""Column functions: digests, names, paths, headers, globs, checksums."""
