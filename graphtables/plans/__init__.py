"""plans of graphtables."""
