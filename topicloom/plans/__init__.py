"""Compositions of the operators: whole runs and the shared data-movement helpers."""
