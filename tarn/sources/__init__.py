"""Files, directories, tables and in-memory rows as DataFrames."""
