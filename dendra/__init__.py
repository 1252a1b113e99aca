"""dendra — document clustering and retrieval as Spark DataFrame jobs.

Every public operator is a DataFrame -> DataFrame function built on public
PySpark APIs; numeric kernels run as NumPy inside Arrow-batched pandas tasks
only where Spark has no built-in (block vector products, per-window union-find).
"""

__version__ = "0.1.0"
