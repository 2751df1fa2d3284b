"""Column-valued functions: bits, packing, geometry and code names."""
