"""Factloom: a PySpark toolkit that turns source estates into a queryable catalog.

Every operator takes DataFrames and returns a DataFrame keyed by ``repo``.
"""

__version__ = "0.1.0"
EXTRACTOR_VERSION = 1
