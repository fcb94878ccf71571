"""Training-data operators over text, pages and vectors. Nothing else in the package imports this subpackage."""
