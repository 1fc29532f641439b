"""Analytics operators, each a function on DataFrames."""
