"""Causal market analytics on Spark."""
