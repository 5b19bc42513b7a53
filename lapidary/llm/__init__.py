"""Training-data operators: ten pipeline components on DataFrames (nothing outside this folder imports them)."""
