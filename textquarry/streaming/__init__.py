"""Streams: the row-local features and windowed rollups over unbounded input."""
