"""Query descriptions and their compilation to DataFrames."""
