"""Structural array queries on Spark."""
