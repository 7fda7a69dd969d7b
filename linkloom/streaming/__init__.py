"""Candidates for records that arrive in a stream."""
