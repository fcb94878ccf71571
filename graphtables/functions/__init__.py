"""functions of graphtables."""
