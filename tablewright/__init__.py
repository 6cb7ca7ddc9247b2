"""tablewright: delimited-table statistics as Spark plans."""

__version__ = "0.2.0"
