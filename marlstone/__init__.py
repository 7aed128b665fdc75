"""Marlstone: record linkage, release-title analytics and corpus operators on PySpark."""

__version__ = "0.1.0"
