"""operators of graphtables."""
