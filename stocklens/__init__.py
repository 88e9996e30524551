"""stocklens: retail stock-versus-sales analytics on Spark DataFrames.

Every operator takes and returns DataFrames and works on all clients at once,
with ``client_id`` as the leading key.
"""

__version__ = "0.1.0"
