"""streaming of graphtables."""
