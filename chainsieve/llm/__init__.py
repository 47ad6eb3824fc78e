"""Operators for preparing model training data; nothing outside this folder imports it."""
