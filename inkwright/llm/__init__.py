"""Operators for preparing training data at cluster scale."""
