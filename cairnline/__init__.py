"""Cairnline: comparative analysis of ordered landmark series on PySpark."""

__version__ = "0.1.0"
