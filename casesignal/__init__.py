"""casesignal: case-report signals, features and classifiers on PySpark.

Subpackages
-----------
sources    text, parquet and CSV tables in; tables and models out
functions  column expressions (names, scalars, hashed bits) and fixed word lists
operators  one relational step each: joins, counts, ranks, signals, metrics
plans      whole pipelines built from the operators
catalog    the registered queries and their SQL twins
"""

__version__ = "0.1.0"
