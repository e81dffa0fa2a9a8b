"""Composed plans: routing and the cleaning pipeline."""
