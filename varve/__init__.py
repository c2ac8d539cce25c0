"""varve: a lakehouse batch workload as Spark DataFrame functions.

Layers (raw, bronze, silver, gold), a change feed folded into a type 2 dimension,
22 decision-support queries, data quality, reconciliation, policy obligations and
source-corpus analytics. Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
