"""Set-based operators, each a function from DataFrames to DataFrames."""
