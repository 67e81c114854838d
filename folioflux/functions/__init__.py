"""Column functions and pure kernels on text."""
