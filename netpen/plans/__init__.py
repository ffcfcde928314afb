"""The jobs, each a plan from tables to result DataFrames."""
