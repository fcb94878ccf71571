"""sources of graphtables."""
