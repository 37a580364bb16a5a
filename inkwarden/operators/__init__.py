"""DataFrame operators: one module per family, each function takes and returns DataFrames."""
