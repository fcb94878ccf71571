"""graphtables: graph-shaped analytics over ordinary node and edge tables, as plain DataFrame functions on Spark."""

__version__ = "0.1.0"
