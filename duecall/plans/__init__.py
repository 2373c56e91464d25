"""Compositions of operators: whole jobs."""
