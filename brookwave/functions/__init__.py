"""Column functions: bits, clocks, scales and deterministic generators."""
