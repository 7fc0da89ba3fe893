"""NumPy kernels for one series, system, signal or field; no Spark in here."""
