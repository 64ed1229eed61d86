"""Pure functions from DataFrames to DataFrames, one module per layer."""
