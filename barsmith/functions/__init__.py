"""Indicators, factors and strategies as columns."""
