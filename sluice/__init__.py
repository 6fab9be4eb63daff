"""Dataset-scale operators for sorting, joining, range sums, lists, matrices, dictionaries and graphs on Spark."""

__version__ = "0.1.0"
