"""Operators: DataFrames in, DataFrames out. Candidate pairs are edges (s1_id, cand_id) throughout."""
