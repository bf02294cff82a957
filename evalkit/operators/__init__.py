"""Relational operators of the evaluation pipeline, as functions from DataFrame to DataFrame."""
