"""potentia: voltage-map analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers, writers,
generators), ``operators`` (distance joins, graphs, solvers, clustering, tuning,
embedding), ``plans`` (flows and the query registry), ``streaming`` (Structured Streaming).
"""

__version__ = "0.1.0"
