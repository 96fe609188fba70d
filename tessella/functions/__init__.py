"""Column functions and the NumPy kernels that Spark has no primitive for."""
