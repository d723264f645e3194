"""Group-local numerical kernels: plain numpy, no Spark."""
