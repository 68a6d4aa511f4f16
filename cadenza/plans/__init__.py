"""Pipelines: a declared list of operators, rewritten before it runs, and the standard paths."""
